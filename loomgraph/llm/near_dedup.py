"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Method: a document's set holds the hashes of its distinct five-word shingles. One permutation scatters the set over a
circle of 2^32 places, a second one, shifted by k places, gives coordinate k of the signature: the least value that the
set takes (C-MinHash with two permutations). Bands of the signature put documents into buckets; those that share a
bucket are candidates for one another, and their full sets (of 64-bit shingle hashes) are compared exactly.

Scale and skew: documents with one and the same set are one class from the start, met through map-side aggregation, so
exact copies in any number cost a row for each task. Buckets with the same members count once. Every member is first compared with its bucket's smallest one, in
parts of at most BLOCK_SETS members; the links found settle most buckets. Only a bucket whose members are not all connected by then has its other pairs compared, in
pairs of blocks with a task for each, which return a spanning forest of the links they find. Texts that merely chain through buckets are never compared
across them, and no link between two candidates goes unseen. At the threshold a pair misses all bands with probability (1 - 0.85^6)^40 < 1e-8.

Defined results: a document with fewer than five words has one shingle, of all its words; without words or text the set is
empty and linked with nothing. A row without an id is linked with nothing, has no component and is kept. Rows that repeat
an id and differ in text are linked through the id. Columns besides the id and the text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import common

ROWS, BANDS = 6, 40
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Sets, and shingles in them, that one block of a bucket holds.
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 8192


def _permuted(x: np.ndarray, spare: np.ndarray) -> None:
    """A bijection of 32-bit words, in place (the finaliser of MurmurHash3)."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signatures(sets: list[np.ndarray], size: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: [len(sets), size] 32-bit words."""
    out = np.empty((len(sets), size), dtype=np.uint32)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):
            end, n = at, 0
            while end < len(sets) and (n + len(sets[end]) <= 40_000 or end == at):
                n += len(sets[end])
                end += 1
            begins = np.cumsum([0, *map(len, sets[at : end - 1])])
            flat = np.concatenate(sets[at:end])
            place = (common.mix64(flat ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
            value, spare = np.empty_like(place), np.empty_like(place)
            for k in range(size):
                np.subtract(place, np.uint32(k), out=value)
                _permuted(value, spare)
                out[at:end, k] = np.minimum.reduceat(value, begins)
            at = end
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit bucket keys [documents, bands]; a key holds its band's number."""
    n, size = signature.shape
    parts = signature.reshape(n, size // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
        for j in range(rows):
            key = common.mix64(key * np.uint64(0xFF51AFD7ED558CCD) + parts[:, :, j])
    return key.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    """Name of a set: equal for equal sets only."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _described(docs: DataFrame, id_col: str, text_col: str, rows: int, bands: int) -> DataFrame:
    """(_id, n_shingles, digest, keys) of every row."""

    def run(batches):
        for b in batches:
            sets = list(common.shingle_sets(map(common.as_bytes, b.column(1).to_pylist())))
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full, rows * bands), rows).tolist() if full else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["_id", "n_shingles", "digest", "keys"],
            )

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(run, "_id long, n_shingles long, digest binary, keys array<long>")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections of two lists of sets, as [left, right]."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    known, df = np.unique(np.concatenate(left), return_counts=True)
    if left is right:
        known = known[df > 1]
    else:
        other = np.unique(np.concatenate(right))
        known = np.intersect1d(known, other, assume_unique=True)
    for at in range(0, len(known), COLUMNS):
        columns = known[at : at + COLUMNS]

        def marks(sets, columns=columns):
            m = np.zeros((len(sets), len(columns)), dtype=np.float32)
            for i, s in enumerate(sets):
                part = s[np.searchsorted(s, columns[0]) : np.searchsorted(s, columns[-1], side="right")]
                where = np.searchsorted(columns, part)
                m[i, where[columns[where] == part]] = 1
            return m

        a = marks(left)
        out += a @ (a if left is right else marks(right)).T
    if left is right:
        np.fill_diagonal(out, list(map(len, left)))
    return out


def links(ids: list[int], sets: list[np.ndarray], block: list[int], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between sets: all pairs if the block numbers agree, else pairs across the two blocks."""
    lo = min(block)
    left = [i for i, x in enumerate(block) if x == lo]
    right = [i for i, x in enumerate(block) if x != lo] or left
    a, b = [sets[i] for i in left], [sets[i] for i in right]
    if left is right:
        b = a
    both = _overlaps(a, b)
    sizes = np.array([len(s) for s in a], dtype=np.float64)[:, None] + np.array([len(s) for s in b], dtype=np.float64)[None, :]
    hit = 100 * both.astype(np.float64) >= percent * (sizes - both)
    if left is right:
        hit = np.triu(hit, 1)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
        u, v = root(left[i]), root(right[j])
        if u != v:
            parent[v] = u
            yield ids[left[i]], ids[right[j]]


def _sets(batches) -> Iterator[tuple]:
    """The rows of batches (key, i, j, own, node, digest, text) with their text's shingles in place of digest and text; texts of another digest, which came by a repeated id, are left out."""
    for b in batches:
        *columns, digests, texts = (c.to_pylist() for c in b.columns)
        for row, d, held in zip(zip(*columns, strict=True), digests, common.shingle_sets(map(common.as_bytes, texts)), strict=True):
            if digest(held) == d:
                yield (*row, held)


def _groups(batches) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Runs of rows with equal (key, i, j): ids, blocks and sets."""
    now, ids, block, sets = None, [], [], []
    for root, i, j, own, node, held in _sets(batches):
        if (root, i, j) != now:
            if len(ids) > 1:
                yield ids, block, sets
            now, ids, block, sets = (root, i, j), [], [], []
        ids.append(node)
        block.append(own)
        sets.append(held)
    if len(ids) > 1:
        yield ids, block, sets


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _starred(batches, percent: int) -> Iterator[tuple[int, int]]:
    """Links of members to the head of their part; rows (head, part, part, order, node, digest, text) come sorted, the head first."""
    now, head = None, None
    for root, part, _, order, node, held in _sets(batches):
        if not order:
            now, head = (root, part), held
        elif now == (root, part) and _similar(head, held, percent):
            yield node, root


def _pairs(links: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Links as batches."""
    while some := list(islice(links, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([y for _, y in some], pa.int64())], ["a", "b"])


def candidate_buckets(classes: DataFrame) -> DataFrame:
    """(key, node, head, n) of the members of every bucket with n > 1 members of classes (node, keys); of buckets with the same members one is left."""
    banded = classes.select("node", F.explode("keys").alias("key"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"members{i}") for i in (1, 2)]
    buckets = banded.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n"), *members).filter("n > 1")
    one = buckets.groupBy("head", "n", "members1", "members2").agg(F.min("key").alias("key")).select("key", "head", "n")
    return banded.join(one, "key").select("key", "node", "head", "n")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node) of buckets whose members the labels (node, component) do not hold together yet. Buckets of two have had their pair compared."""
    named = buckets.filter("n > 2").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    parted = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return named.join(parted, "key").select("key", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: component_id is the smallest id that links reach."""
    spark = docs.sparkSession
    common.ship(spark)
    described = common.saved(_described(docs, id_col, text_col, rows, bands), "near-described")
    usable = described.filter("_id IS NOT NULL AND n_shingles > 0")
    classes = common.saved(usable.groupBy("digest").agg(F.min("_id").alias("node"), F.max("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.count("*").alias("rows")), "near-classes")
    buckets = common.saved(candidate_buckets(classes), "near-buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))

    def dealt(sent: DataFrame) -> DataFrame:
        """The classes' texts at the places (node, to) that they are sent to, sorted there. Texts travel and not sets, which are larger and don't deflate; each is read once, however many places it goes to."""
        places = sent.groupBy("node").agg(F.collect_list("to").alias("to")).join(classes.select("node", "digest"), "node").join(texts, "node")
        rows = places.select(F.explode("to").alias("to"), "node", "digest", "text").select("to.key", "to.i", "to.j", "to.own", "node", "digest", "text")
        return rows.repartition(common.partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "own")

    # Members of a bucket against its smallest one.
    near = buckets.filter("node <> head").select("node", "head").distinct()
    parts = near.groupBy("head").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts"))
    near = near.join(parts, "head").select("node", "head", F.expr("cast(pmod(xxhash64(node, 'part'), parts) as int)").alias("part"))
    at = lambda own: F.struct(F.col("head").alias("key"), F.col("part").alias("i"), F.col("part").alias("j"), F.lit(own).alias("own")).alias("to")
    sent = near.select("node", at(1)).unionByName(near.select("head", "part").distinct().select(F.col("head").alias("node"), at(0)))
    stars = dealt(sent).mapInArrow(lambda batches: _pairs(_starred(batches, percent)), "a long, b long")
    # An id that comes with several texts holds their classes together.
    repeated = usable.groupBy("_id").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("n > 1 AND low <> high").select("_id")
    through = usable.join(repeated, "_id").join(classes.select("digest", "node"), "digest").filter("_id <> node").select(F.col("_id").alias("a"), F.col("node").alias("b"))
    joined = common.saved(connected_components(stars.unionByName(through)), "near-stars")

    # Buckets that are not settled: each pair of blocks is a task of its own.
    unsettled = common.saved(open_buckets(buckets, joined), "near-open")
    if unsettled.head(1):
        members = unsettled.join(classes.select("node", "n_shingles"), "node")
        sized = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        placed = members.join(sized, "key").select("node", "key", "blocks", F.expr("cast(pmod(xxhash64(node, 'block'), blocks) as int)").alias("own"))
        spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own").alias("to"))
        rest = dealt(spread).mapInArrow(lambda batches: _pairs(x for ids, block, held in _groups(batches) for x in links(ids, held, block, percent)), "a long, b long")
        rest = common.saved(rest, "near-rest")
        if rest.head(1):
            joined = connected_components(rest.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    labelled = classes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    whole = common.join_unique(usable.select("_id", "n_shingles", "digest"), labelled, "digest", classes.select("digest", F.col("rows").alias("n"))).select("_id", "n_shingles", "component_id")
    # Rows without an id have no component, rows without words one of their own.
    alone = described.filter("_id IS NULL OR n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("_id").isNull() | (F.col("_id") == F.col("component_id"))).withColumnRenamed("_id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, one of each group of near-duplicates: that with the smallest id.

    Decided by row: rows that repeat an id and its text are one, and rows that repeat an id with other texts are told apart and linked by their texts alone (they come before the others of
    their group). Rows without an id, or without words, all stay. Column order and extra columns stay as they are.
    """
    own = docs.columns
    row, again, gone_ = common.private(own, "row", "again", "gone")
    named = docs.filter(F.col(id_col).isNotNull())
    repeated = common.saved(named.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(id_col).alias(again)), "near-repeated")
    rows, rest = named.select(*own, F.col(id_col).cast("long").alias(row)), docs.filter(F.col(id_col).isNull())
    if repeated.head(1):
        text = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
        several = named.join(repeated, F.col(id_col) == F.col(again), "left_semi").select(F.col(id_col).alias("id"), text.alias("digest"), F.struct(*own).alias("kept"))
        worded = F.coalesce(F.regexp_count(F.col(f"kept.{text_col}").cast("string"), F.lit(common.WORD)), F.lit(0)) > 0
        # Numbers below those of the ids; rows without words are not collapsed.
        once = several.filter(worded).groupBy("id", "digest").agg(F.first("kept").alias("kept"))
        number = -F.pmod(F.xxhash64("id", "digest"), F.lit(1 << 62)) - F.lit(1 << 62)
        rows = rows.join(repeated, F.col(id_col) == F.col(again), "left_anti").unionByName(once.select("kept.*", number.alias(row)))
        rest = rest.unionByName(several.filter(~worded).select("kept.*"))
    texts = rows.select(F.col(row).alias("id"), F.col(text_col).alias("text"))
    gone = near_duplicates(texts, "id", "text", **options).filter(~F.col("kept")).select(F.col("id").alias(gone_))
    return rows.join(gone, F.col(row) == F.col(gone_), "left_anti").select(*own).unionByName(rest)
