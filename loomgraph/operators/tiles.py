"""Correlations of all pairs of columns of a long table, as products of tiles of the standardised matrix.

Cells (rows of the matrix) are dealt to chunks and genes (its columns) to blocks; a packed row holds one block's values in one chunk as arrays. A task has two blocks: it streams their chunks past
each other and adds six sums of products (presence, sums, squares and cross products over the cells that both genes have), so pairs never are rows, and only pairs that reach the least correlation leave it.

What is shuffled is each value once to be packed, and each packed value once for every block that its own meets: genes / GENES times. Two blocks meet only if they share a chunk, and blocks whose genes all have every cell only if the
norms of their genes within the chunks let a correlation reach the least one (Cauchy-Schwarz chunk by chunk). Genes with most of their variance in the same chunk share blocks, so that bound drops tiles where genes vary in different cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import partitions, saved, ship

#: Genes of a block and cells of a chunk, about.
GENES, CELLS = 512, 1024
#: Variances below this share of the gene's own are rounding.
FLAT = 1e-13


def _positions(names: DataFrame, group: str) -> DataFrame:
    """names (name, group column) with the place of each within its group, which has a bounded number of them, and the group's size."""
    own = Window.partitionBy(group)
    return names.withColumn("pos", (F.row_number().over(own.orderBy("name")) - 1).cast("int")).withColumn("size", F.count("*").over(own).cast("int"))


def packed(effects: DataFrame, genes: int = GENES, cells: int = CELLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of a block in a chunk, genes with block and place, blocks by chunk with their largest norms) of effects (cell, gene, effect); repeated cells of a gene are rows of their own."""
    known = effects.filter("cell IS NOT NULL AND gene IS NOT NULL AND effect IS NOT NULL")
    means = known.groupBy("gene").agg(F.avg(F.col("effect").cast("double")).alias("mean"))
    moved = known.join(means, "gene").select("cell", "gene", (F.col("effect").cast("double") - F.col("mean")).alias("x"))  # centred first, so that large means do not swallow the variance
    values = saved(moved.groupBy("cell", "gene").agg(F.count("*").cast("double").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q")), "tiles-values")
    n_cells = values.agg(F.count_distinct("cell")).first()[0]
    chunks = max(1, -(-n_cells // cells))
    chunk = F.pmod(F.xxhash64("cell"), F.lit(chunks)).cast("int")
    of_cells = _positions(values.select(F.col("cell").alias("name")).distinct().withColumn("chunk", F.pmod(F.xxhash64("name"), F.lit(chunks)).cast("int")), "chunk").select(F.col("name").alias("cell"), "chunk", F.col("pos").alias("k"), F.col("size").alias("in_chunk"))
    by_chunk = values.groupBy("gene", chunk.alias("chunk")).agg(F.sum("q").alias("v"), F.sum("c").alias("n"), F.count("*").alias("cells"))
    facts = by_chunk.groupBy("gene").agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("n").alias("n"), F.max_by("chunk", F.struct("v", "chunk")).alias("home"), (F.sum("cells") == n_cells).alias("full"))
    sizes = facts.groupBy("home").agg(F.ceil(F.count("*") / genes).cast("int").alias("parts"))
    dealt = facts.join(sizes, "home").withColumn("block", F.concat_ws(".", "home", F.pmod(F.xxhash64("gene"), F.col("parts"))))
    numbers = dealt.select("block").distinct().select("block", F.row_number().over(Window.orderBy("block")).cast("int").alias("b"))  # a row for each block
    placed = saved(_positions(dealt.join(numbers, "block").withColumn("name", F.col("gene")), "b").select("gene", "b", F.col("pos").alias("g"), F.col("size").alias("in_block"), F.sqrt("v").alias("sd"), "n", "full"), "tiles-genes")
    norms = by_chunk.drop("n").join(placed, "gene").groupBy("b", "chunk").agg(F.max(F.sqrt(F.col("v") / F.col("n")) / F.nullif("sd", F.lit(0.0))).alias("peak"), F.every("full").alias("full"))
    scaled = values.join(placed.filter("sd > 0"), "gene").join(of_cells, "cell").select("b", "chunk", "g", "k", "in_block", "in_chunk", "c", (F.col("s") / F.col("sd")).alias("s"), (F.col("q") / F.col("sd") ** 2).alias("q"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["in_block"].iloc[0]), int(pdf["in_chunk"].iloc[0]))
        out = {"b": [pdf["b"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "rows": [shape[0]], "columns": [shape[1]]}
        for name in "csq":
            m = np.zeros(shape)
            m[pdf["g"].to_numpy(), pdf["k"].to_numpy()] = pdf[name].to_numpy()
            out[name] = [m.tobytes()]
        return pd.DataFrame(out)

    rows = scaled.groupBy("b", "chunk").applyInPandas(pack, "b int, chunk int, rows int, columns int, c binary, s binary, q binary")
    return rows, placed, norms


def tiles(norms: DataFrame, least: float) -> DataFrame:
    """(i, j), i <= j, of the blocks that can hold a correlation of at least ``least``."""
    x, y = norms.select("chunk", F.col("b").alias("i"), F.col("peak").alias("p"), F.col("full").alias("f")), norms.select("chunk", F.col("b").alias("j"), F.col("peak").alias("o"), F.col("full").alias("e"))
    meet = x.join(y, "chunk").filter("i <= j").groupBy("i", "j").agg(F.sum(F.coalesce(F.col("p") * F.col("o"), F.lit(0.0))).alias("reach"), F.every(F.col("f") & F.col("e")).alias("full"))
    return meet.filter(~F.col("full") | (F.col("reach") >= least - 1e-9)).select("i", "j")


class _Sums:
    """Sums of products of two blocks over the chunks seen so far."""

    def __init__(self, i: int, j: int):
        self.i, self.j, self.chunk, self.held, self.total = i, j, None, {}, None

    def add(self, chunk: int, block: int, c: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        if chunk != self.chunk:
            self.chunk, self.held = chunk, {}
        self.held[block] = (c, s, q)
        if self.i in self.held and self.j in self.held:
            (c, s, q), (d, t, r) = self.held[self.i], self.held[self.j]
            new = [c @ d.T, s @ d.T, c @ t.T, q @ d.T, c @ r.T, s @ t.T]
            self.total = new if self.total is None else [a + b for a, b in zip(self.total, new, strict=True)]

    def pairs(self, least: float) -> pa.RecordBatch | None:
        if self.total is None:
            return None
        n, x, y, xx, yy, xy = self.total
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
            corr = (xy / n - x / n * (y / n)) / np.sqrt(vx * vy)
            told = (n > 1) & (vx > FLAT * xx / n) & (vy > FLAT * yy / n) & (np.abs(corr) >= least)
        if self.i == self.j:
            told &= np.triu(np.ones(told.shape, dtype=bool), 1)
        g, h = np.nonzero(told)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), self.i, dtype=np.int32)), pa.array(g.astype(np.int32)), pa.array(np.full(len(g), self.j, dtype=np.int32)), pa.array(h.astype(np.int32)), pa.array(np.clip(corr[g, h], -1, 1))], ["i", "g", "j", "h", "corr"])


def correlations(effects: DataFrame, least: float, genes: int = GENES, cells: int = CELLS) -> DataFrame:
    """(a, b, corr), a < b, of the genes whose effects over the cells that both have correlate by at least ``least`` in size. effects: cell, gene, effect.

    Rows without a cell, gene or effect count nowhere. A pair with fewer than two common cells, or without variance over them, has no correlation.
    """
    spark = effects.sparkSession
    ship(spark)
    rows, placed, norms = packed(effects, genes, cells)
    meeting = saved(tiles(norms, least), "tiles-meeting")
    ends = meeting.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("b"))
    sent = rows.join(ends, "b").select("i", "j", "chunk", "b", "rows", "columns", "c", "s", "q")

    def run(batches):
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or (now.i, now.j) != (r["i"], r["j"]):
                    if now is not None and (out := now.pairs(least)) is not None:
                        yield out
                    now = _Sums(r["i"], r["j"])
                shape = (r["rows"], r["columns"])
                now.add(r["chunk"], r["b"], *(np.frombuffer(r[x]).reshape(shape) for x in "csq"))
        if now is not None and (out := now.pairs(least)) is not None:
            yield out

    found = sent.repartition(partitions(spark), "i", "j").sortWithinPartitions("i", "j", "chunk", "b").mapInArrow(run, "i int, g int, j int, h int, corr double")
    name = lambda block, pos, to: placed.select(F.col("b").alias(block), F.col("g").alias(pos), F.col("gene").alias(to))
    named = found.join(name("i", "g", "x"), ["i", "g"]).join(name("j", "h", "y"), ["j", "h"])
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "corr")
