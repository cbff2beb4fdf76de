"""Exact best partners by inner product within documents, without a row for each pair.

A document's items are packed in blocks. The side that is searched is cut into parts of near items (by their place along the direction in which a block varies most), each with its centre and radius; a task has a block of the asking side, streams the document's
parts past it and keeps each item's best partner. A part is skipped where no asking item can do better in it: an inner product with an item of the part is at most that with the centre plus the asking vector's norm times the radius. A large document has many blocks and fills
as many tasks; what is sent is each part once for each asking block, and what comes back a row for each asking item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..runtime import partitions, saved, ship

#: Items of an asking block and of a coarse block of the other side, about, and of a part at most.
BLOCK, PART = 1024, 64
#: Similarities that agree to so many digits are ties, which go to the first by name.
DIGITS = 12


def _blocks(df: DataFrame, doc: str, item: str, vector: str) -> DataFrame:
    """(_doc, _item, _v, _block) of items that have a vector, dealt to blocks of about BLOCK items of their document."""
    rows = df.filter(F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(doc).alias("_doc"), F.col(item).alias("_item"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    size = rows.groupBy("_doc").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    return rows.join(size, "_doc").withColumn("_block", F.pmod(F.xxhash64("_item"), F.col("_blocks")).cast("int"))


def _packed(rows: DataFrame, cut: bool) -> DataFrame:
    """Packed rows (_doc, _block, _blocks, names, matrix) and, where blocks are cut into parts, centre and radius."""
    names = ArrayType(rows.schema["_item"].dataType)
    kind = StructType([rows.schema["_doc"], StructField("_block", IntegerType()), StructField("_blocks", IntegerType()), StructField("names", names), StructField("matrix", BinaryType()), StructField("centre", BinaryType()), StructField("radius", DoubleType())])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_item")
        v, items = np.stack(pdf["_v"].to_numpy()).astype(np.float64), pdf["_item"].to_numpy()
        order = np.arange(len(v))
        if cut and len(v) > PART:
            c = v - v.mean(axis=0)
            d = c[np.argmax((c * c).sum(axis=1))]
            for _ in range(5):  # towards the direction of the largest variance
                d = c.T @ (c @ d)
                d /= max(np.linalg.norm(d), 1e-300)
            order = np.argsort(c @ d, kind="stable")
        out = []
        for at in range(0, len(v), PART if cut else len(v)):
            some = np.sort(order[at : at + PART]) if cut else order  # by name within a part
            centre = v[some].mean(axis=0)
            out.append((pdf["_doc"].iloc[0], pdf["_block"].iloc[0], pdf["_blocks"].iloc[0], items[some].tolist(), v[some].tobytes(), centre.tobytes(), float(np.sqrt(((v[some] - centre) ** 2).sum(axis=1).max()))))
        return pd.DataFrame(out, columns=kind.fieldNames())

    return rows.groupBy("_doc", "_block").applyInPandas(pack, kind)


def best_partners(asking: DataFrame, other: DataFrame, doc: str = "doc", item: str = "item", vector: str = "v", partner: str = "partner") -> DataFrame:
    """(doc, item, partner, similarity, looked, parts): for each asking item (doc, item, v) the partner (doc, partner, v) of its document with the largest inner product, how many of the document's parts its block looked into, and how many there are.

    Items without a vector, or whose document has no partners, have no row. Vectors of a document are of one length.
    """
    spark = asking.sparkSession
    ship(spark)
    left = _packed(_blocks(asking, doc, item, vector), False)
    right = saved(_packed(_blocks(other, doc, partner, vector), True), "nearest-parts")
    sides = left.groupBy("_doc").agg(F.max("_blocks").alias("_n"))
    sent = right.join(sides, "_doc").select("_doc", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block"), F.lit(1).alias("side"), F.lit(None).cast(left.schema["names"].dataType).alias("items"), F.col("names").alias("partners"), "matrix", "centre", "radius")
    asked = left.select("_doc", "_block", F.lit(0).alias("side"), F.col("names").alias("items"), F.lit(None).cast(right.schema["names"].dataType).alias("partners"), "matrix", "centre", "radius")
    fields = [asking.schema[doc], asking.schema[item], other.schema[partner]]
    out = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("similarity", DoubleType()), StructField("looked", LongType()), StructField("parts", LongType())])
    kinds = (fields[0].dataType, fields[1].dataType, fields[2].dataType)

    class Block:
        def __init__(self, row: dict):
            self.doc, self.items = row["_doc"], row["items"]
            self.v = np.frombuffer(row["matrix"]).reshape(len(self.items), -1)
            self.norm = np.sqrt((self.v * self.v).sum(axis=1))
            self.best, self.name, self.looked, self.parts = np.full(len(self.items), -np.inf), [None] * len(self.items), 0, 0

        def see(self, row: dict) -> None:
            self.parts += 1
            reach = self.v @ np.frombuffer(row["centre"]) + self.norm * row["radius"]
            if (reach + 10.0**-DIGITS < self.best).all():
                return
            self.looked += 1
            s = np.round(self.v @ np.frombuffer(row["matrix"]).reshape(len(row["partners"]), -1).T, DIGITS)
            at = s.argmax(axis=1)
            top = s[np.arange(len(s)), at]
            for i in np.flatnonzero(top >= self.best).tolist():
                name = row["partners"][at[i]]
                if top[i] > self.best[i] or name < self.name[i]:
                    self.best[i], self.name[i] = top[i], name

        def rows(self) -> pa.RecordBatch | None:
            if not self.parts:
                return None
            from pyspark.sql.pandas.types import to_arrow_type

            n = len(self.items)
            columns = [pa.array([self.doc] * n, to_arrow_type(kinds[0])), pa.array(self.items, to_arrow_type(kinds[1])), pa.array(self.name, to_arrow_type(kinds[2])), pa.array(self.best), pa.array([self.looked] * n, pa.int64()), pa.array([self.parts] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, out.fieldNames())

    def run(batches):
        now, key = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["side"] == 0:
                    if now is not None and (done := now.rows()) is not None:
                        yield done
                    now, key = Block(r), (r["_doc"], r["_block"])
                elif now is not None and key == (r["_doc"], r["_block"]):
                    now.see(r)
        if now is not None and (done := now.rows()) is not None:
            yield done

    return asked.unionByName(sent).repartition(partitions(spark), "_doc", "_block").sortWithinPartitions("_doc", "_block", "side").mapInArrow(run, out)
