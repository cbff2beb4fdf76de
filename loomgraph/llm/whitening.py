"""Whitening of embeddings over their exact distinct vectors.

Method: each entry becomes the integer floor(scale * c). The distinct integer vectors, each once, are the fit list of n vectors with sums S. Rows n * x - S are exact integers, so nothing is lost to
cancellation, however far the vectors lie from the origin; divided by n they are the rows of an MLlib ``RowMatrix``, whose Gramian divided by n is the covariance. The driver decomposes it (its size is
the square of the vectors' width and has nothing to do with their number) and broadcasts the leading components to ``mapInPandas``, which projects every row.

Scale and skew: the fit list is a ``distinct`` with partial aggregation, so a vector that a third of the rows repeat is sent once by each task; it is written to the shared folder and read by the sums, the
Gramian and the check of the result. Rows themselves are never shuffled.

Defined results: a vector that is null, or holds a null or non-finite entry, takes no part. Shorter vectors count as filled up with zeros, an empty one as zeros only. Repeated rows, rows of one id and
rows without an id are rows of their own. A component whose eigenvalue is zero up to rounding (one distinct vector, constant dimensions) has no direction to scale: its coordinate and its explained share are 0.0, and it takes no part in
``identity_error``, which is 0.0 where no component is left. Entries beyond a long are held at its ends. Columns besides the id and the vector are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 256
COMPONENTS = 4


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S; columns are unit eigenvectors of their covariance, values falling eigenvalues."""

    n: int
    sums: tuple[int, ...]
    columns: np.ndarray  # [width, components]
    values: np.ndarray  # [components]; 0 for a component without variance
    trace: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as exact integers: of 64 bits if they fit, else Python's."""
        largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * largest + max((abs(s) for s in self.sums), default=0) < 1 << 63:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (self.rows(x) / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates over the components, each of variance 1 over the fit list."""
        scale = np.divide(1.0, np.sqrt(self.values), out=np.zeros_like(self.values), where=self.values > 0)
        return self.centred(x) @ self.columns * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact squared lengths of n * x - S."""
        rows = self.rows(x)
        if rows.dtype != object and rows.size and float(np.abs(rows.astype(np.float64)).max()) ** 2 * rows.shape[1] >= 2.0**62:
            rows = rows.astype(object)
        return [int(s) for s in (rows * rows).sum(axis=1)] if rows.size else [0] * len(rows)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(_id, _x) of the rows that take part: the id as text and floor(scale * c) of each entry."""
    cells = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    whole = F.forall(cells, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.filter(F.col(vec_col).isNotNull() & whole).select(F.col(id_col).cast("string").alias("_id"), F.transform(cells, lambda c: F.floor(F.lit(float(scale)) * c)).alias("_x"))


def filled(rows: DataFrame, width: int) -> DataFrame:
    """Every vector filled up with zeros to the width."""
    return rows.withColumn("_x", F.concat("_x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("_x"))))


def covariance(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Covariance of the fit list by the Gramian of its centred rows."""
    centre = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"row": list(centre.centred(np.stack(b["_x"].to_numpy())))})

    rows = fit.select("_x").mapInPandas(run, "row array<double>").select(array_to_vector("row").alias("row"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), n, len(sums)).computeGramianMatrix().toArray()
    return gram / n


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The leading components of a fit list of filled vectors (_x)."""
    n = fit.count()
    told = fit.select(F.posexplode("_x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()  # a row for each dimension
    sums = tuple(int(r["s"]) for r in told)
    if not sums:
        return Whitening(n, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    matrix = covariance(fit, n, sums)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    kept = np.where(values[order] > values[-1] * len(sums) * np.finfo(np.float64).eps, values[order], 0.0)
    return Whitening(n, sums, vectors[:, order], kept, float(np.trace(matrix)))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the fit list's coordinates minus the identity, measured on the coordinates themselves."""
    held = np.flatnonzero(model.values > 0)
    if not len(held):
        return 0.0
    names, shared = [f"w{i}" for i in range(len(held))], fit.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame(shared.value.whitened(np.stack(b["_x"].to_numpy()))[:, held], columns=names)

    pairs = [(i, j) for i in range(len(held)) for j in range(i, len(held))]
    told = fit.select("_x").mapInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(told, pairs, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each leading component.

    ``deviation`` is decimal(38,0), since its square of n leaves a long once n times an entry passes some 10^9.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    kind, rows = vectors.schema[id_col].dataType, integer_vectors(vectors, id_col, vec_col, scale)
    width = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    rows = filled(rows, width)
    fit = common.saved(rows.select("_x").distinct(), "fit-list")
    model = fitted(fit, components)
    error, shared = identity_error(fit, model), spark.sparkContext.broadcast(model)

    def run(batches):
        from decimal import Context

        model, exact = shared.value, Context(prec=38)
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for b in batches:
            if len(b) and k:
                x = np.stack(b["_x"].to_numpy())
                yield pd.DataFrame({
                    "_id": np.repeat(b["_id"].to_numpy(), k),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(b)),
                    "deviation": np.repeat(np.array([exact.create_decimal(d) for d in model.deviations(x)], dtype=object), k),
                    "whitened": model.whitened(x).ravel(),
                    "explained": np.tile(explained, len(b)),
                })

    out = rows.mapInPandas(run, "_id string, component int, deviation decimal(38,0), whitened double, explained double")
    return out.select(F.col("_id").cast(kind).alias(id_col), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
