"""Document fingerprints: bottom-k sketches of word-shingle hashes.

Method: a text's fingerprint holds the k smallest of the distinct 64-bit hashes of its five-word shingles, cut to 48 bits.
The sketch of a union is the k smallest of two sketches together, so parts can be sketched apart and merged. Of two
sketches, the k smallest hashes of the union that occur in both estimate resemblance, and the k-th smallest hash
estimates the number of distinct shingles. Texts of at most k distinct shingles are compared exactly.

As text a sketch is ``bk1.<k>.<base64 of the ascending 48-bit hashes, big-endian>``.

Defined results: a null text is an empty text; a text of fewer than five words has one shingle, of all its words; a text
without words has the empty sketch, which is like another empty sketch (1.0) and unlike any other (0.0). Repeated rows are
rows of their own; rows of one id follow each other in the order of a hash of their texts; a null id comes last. With one row the
next document is the row itself. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 256
BITS = 48
#: Parts of the id order, at most: their first rows are the only rows that are sent twice.
MOST_PARTS = 4096


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The bottom-k sketch of sorted distinct 64-bit hashes."""
    return np.unique(hashes[: k + 8] >> np.uint64(64 - BITS))[:k] if len(hashes) else hashes


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the two sets."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard resemblance of the two sets."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of the first set that the second holds."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def to_string(a: np.ndarray, k: int = K) -> str:
    return f"bk1.{k}." + base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(s: str) -> tuple[np.ndarray, int]:
    """(hashes, k) of a fingerprint."""
    kind, k, data = s.split(".", 2)
    if kind != "bk1":
        raise ValueError("no bottom-k sketch")
    raw = np.frombuffer(base64.b64decode(data), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64), int(k)


def sketches(texts: Iterable[str], k: int = K) -> list[np.ndarray]:
    return [sketch(h, k) for h in common.shingle_sets((common.as_bytes(t) for t in texts))]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows (_part, _copy, _key, id, text) sorted within partitions, so that each row's successor in descending id order is the next row of its part; rows of one id follow by a hash of their texts.

    The id order is cut into parts at quantiles of the ids, and an id that fills parts of its own is cut by the hash; the first row of a part is sent to the part before it as well,
    marked as a copy, so that a part needs no other. Only ids and hashes are read for that, and the texts are shuffled once.
    """
    spark = docs.sparkSession
    key, body = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = max(1, min(MOST_PARTS, 4 * common.partitions(spark)))
    told = docs.select(key.alias("_key")).agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("c"), F.count("*").alias("n")).first()
    # Ids of two parts' rows or more, n / 2 at most. Each is a cut as well, and so the largest id of its part.
    hot = docs.groupBy(key.alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") * n >= 2 * max(told["n"], n)).select("_hot", F.ceil(F.col("_n") * n / max(told["n"], 1)).cast("long").alias("_cuts")).collect()
    cuts = sorted({*(told["c"] or []), *(r["_hot"] for r in hot)}) if n > 1 else []
    # Parts count down from the largest ids: part p holds the keys with p cuts above or at them. Cuts below a key are counted in two steps, whole runs first and then one by one.
    run, below = 64, lambda bounds: F.size(F.filter(bounds, lambda c: c < F.col("_key")))
    runs = below(F.lit(cuts[run - 1 :: run])) if len(cuts) >= run else F.lit(0)
    part = F.lit(len(cuts)) - (runs * run + below(F.slice(F.lit(cuts), runs * run + 1, F.lit(run)))) if cuts else F.lit(0)
    keyed = docs.select(key.alias("_key"), F.col(id_col).alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_hash")).withColumn("_part", part.cast("long") * (2 * n + 2))
    if hot:
        cut = spark.createDataFrame([(r["_hot"], r["_cuts"]) for r in hot], "_hot long, _cuts long")
        piece = F.least(F.floor((F.col("_hash") / 2.0**64 + 0.5) * F.col("_cuts")), F.col("_cuts") - 1).cast("long")
        keyed = keyed.join(F.broadcast(cut), F.col("_key") == F.col("_hot"), "left").withColumn("_part", F.col("_part") + F.coalesce(piece, F.lit(2 * n + 1))).drop("_hot", "_cuts")
    first = F.struct("_key", F.bitwise_not("_hash").alias("_turned"))  # the largest key, then the least hash
    heads = [(r["_part"], *r["k"]) for r in keyed.groupBy("_part").agg(F.max(first).alias("k")).orderBy("_part").collect()]  # a row for each part, 2 * MOST_PARTS at most
    before = [(k, ~turned, heads[i - 1][0]) for i, (_, k, turned) in enumerate(heads)]
    sent = spark.createDataFrame(before, "_key long, _hash long, _before long")
    place = lambda p, copy: F.struct(F.col(p).alias("p"), F.lit(copy).alias("c"))
    both = keyed.join(F.broadcast(sent), ["_key", "_hash"], "left").select("_key", "_hash", "_id", "_text", F.explode(F.when(F.col("_before").isNull(), F.array(place("_part", 0))).otherwise(F.array(place("_part", 0), place("_before", 1)))).alias("_to"))
    rows = both.select(F.col("_to.p").alias("_part"), F.col("_to.c").alias("_copy"), "_key", "_id", "_text", "_hash")
    return rows.repartition(common.partitions(spark), "_part").sortWithinPartitions("_part", "_copy", F.desc("_key"), "_hash", "_text").drop("_hash"), len(heads)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text takes the place of a changed copy: its last half comes from the next document in descending id order,
    after the last from the first.
    """
    common.ship(docs.sparkSession)
    rows, _ = with_following(docs, id_col, text_col)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        held = None  # a row that waits for its successor: (part, id, text, sketch)
        ids, out = [], [[] for _ in range(6)]

        def answer(mine, text, own, following, other):
            new = edited(text, following)
            ids.append(mine)
            changed.append((new, text, own, other))

        changed: list = []
        for b in batches:
            parts, copies, keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4).to_pylist()
            keys = keys.to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < 4_000_000 or end == at):
                    size += len(texts[end])
                    end += 1
                made = sketches(texts[at:end], k)
                for i in range(at, end):
                    if held is not None and held[0] == parts[i]:
                        answer(held[1], held[2], held[3], texts[i], made[i - at])
                        held = None
                    if not copies[i]:
                        held = (parts[i], keys[i], texts[i], made[i - at])
                for (new, text, own, other), s in zip(changed, sketches((c[0] for c in changed), k), strict=True):
                    for column, value in zip(out, (len(text), hashlib.sha256(common.as_bytes(new)).hexdigest(), to_string(own, k), to_string(s, k), resemblance(own, s, k), resemblance(own, other, k)), strict=True):
                        column.append(value)
                if ids:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(3).type), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names)
                    ids.clear()
                    changed.clear()
                    for column in out:
                        column.clear()
                at = end
        if held is not None:
            raise RuntimeError("a part has no row after its last")

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
