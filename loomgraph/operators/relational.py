"""Message passing over a typed graph with given weights, and scores of pairs: the inference side of a relational network, as joins.

Training happens elsewhere; the engine takes the weights as arrays and applies them. Messages are averaged for each node and relation before they meet a matrix, so what is
shuffled is a row for each of these and not for each edge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..runtime import saved, ship

EPSILON = 1e-5


@dataclass(frozen=True)
class Layer:
    """The weights of one layer: relations share basis matrices, each with coefficients and a gate of its own."""

    relations: tuple[str, ...]
    bases: np.ndarray  # [bases, in, out]
    coefficients: np.ndarray  # [relations, bases]
    gates: np.ndarray  # [relations], before the softmax
    root: np.ndarray  # [in, out]
    bias: np.ndarray  # [out]
    gain: np.ndarray  # [out], of the normalisation
    shift: np.ndarray  # [out]

    def matrices(self) -> np.ndarray:
        """[relations, in, out], gates included."""
        gate = np.exp(self.gates - self.gates.max())
        return np.einsum("rb,bio->rio", self.coefficients * (gate / gate.sum())[:, None], self.bases)


def _mapped(df: DataFrame, out: StructType, change) -> DataFrame:
    """df's batches through a function from lists to lists of columns."""
    names = out.fieldNames()

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(change(b), names)

    return df.mapInArrow(run, out)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def apply_layer(features: DataFrame, edges: DataFrame, layer: Layer, residual: bool = True, activate: bool = True) -> DataFrame:
    """(node_id, features) after a layer: the gated mean messages of each relation along edges (src, dst, relation), the node's own part, an activation, the node's features again where sizes agree, and
    a normalisation over the vector. Edges of relations that the layer lacks pass nothing."""
    ship(features.sparkSession)
    known, weights, width = list(layer.relations), layer.matrices(), layer.root.shape[1]
    features = saved(features, "layer-features")  # read for messages and for the node's own part
    whole = lambda f, n: F.array(*(f(F.col("features")[i]) for i in range(n)))  # noqa: E731  a vector's places are aggregated side by side
    sent = edges.filter(F.col("relation").isin(known)).join(features.select(F.col("node_id").alias("src"), "features"), "src").select(F.col("dst").alias("node_id"), "relation", "features")
    mean = sent.groupBy("node_id", "relation").agg(whole(F.avg, weights.shape[1]).alias("features"))
    vector = ArrayType(DoubleType())
    kept = StructType([StructField("node_id", features.schema["node_id"].dataType), StructField("features", vector)])
    number = {r: i for i, r in enumerate(known)}

    def through(b: pa.RecordBatch) -> list:
        own = np.array([number[r] for r in b.column(1).to_pylist()])
        return [b.column(0), _lists(np.einsum("ni,nio->no", _matrix(b.column(2)), weights[own]))]

    got = _mapped(mean.select("node_id", "relation", "features"), kept, through).groupBy("node_id").agg(whole(F.sum, width).alias("messages"))
    both = features.select("node_id", F.transform("features", lambda x: x.cast("double")).alias("features")).join(got, "node_id", "left").select("node_id", "features", F.coalesce("messages", F.lit([0.0] * width)).alias("messages"))

    def finish(b: pa.RecordBatch) -> list:
        own = _matrix(b.column(1))
        h = own @ layer.root + _matrix(b.column(2)) + layer.bias
        if activate:
            h = np.maximum(h, 0)
        if residual and h.shape == own.shape:
            h = h + own
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + EPSILON) * layer.gain + layer.shift
        return [b.column(0), _lists(h)]

    return _mapped(both, kept, finish)


def pair_scores(pairs: DataFrame, features: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b, score) of pairs (a, b): a decoder over their vectors' sum, product and distance, the same for either order; layers are (matrix, bias), the last one with one output."""
    ship(pairs.sparkSession)
    own = features.select("node_id", F.transform("features", lambda x: x.cast("double")).alias("v"))
    both = pairs.select("a", "b").join(own.select(F.col("node_id").alias("a"), F.col("v").alias("x")), "a").join(own.select(F.col("node_id").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")

    def decide(b: pa.RecordBatch) -> list:
        x, y = _matrix(b.column(2)), _matrix(b.column(3))
        h = np.concatenate((x + y, x * y, np.abs(x - y)), axis=1)
        for i, (w, bias) in enumerate(layers):
            h = h @ w + bias
            if i < len(layers) - 1:
                h = np.maximum(h, 0)
        return [b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(h[:, 0], -60, 60))))]

    kind = pairs.schema["a"].dataType
    return _mapped(both, StructType([StructField("a", kind), StructField("b", kind), StructField("score", DoubleType())]), decide)
