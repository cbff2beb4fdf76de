"""Helpers shared by the training-data operators: the shared folder, table reading and hashed word shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; both act on UTF-8 bytes, so other letters stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import partitions, saved, scratch, shared_dir, ship  # noqa: F401

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes hashed at once; longer texts make a chunk of their own.
CHUNK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    """Those columns of a table, whatever else it holds."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def private(columns: Iterable[str], *names: str) -> tuple[str, ...]:
    """These names with as many underscores before them as it takes to be none of the columns, whatever their case."""
    taken, prefix = {c.lower() for c in columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return tuple(prefix + n for n in names)


#: Keys that hold at least one in so many rows are joined by a broadcast.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, tally: DataFrame) -> DataFrame:
    """left inner join right, whose rows are unique in key, where a key may hold any share of left's rows.

    tally (key, n) counts left's rows. Keys that hold at least one in HOT of them, so HOT keys at most, are joined by a broadcast; what is left for the shuffle has no hot key. left is read twice.
    """
    total = tally.agg(F.sum("n")).first()[0] or 0
    hot = right.join(tally.filter(F.col("n") * HOT >= total).select(key), key)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key))


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared URI, usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of SplitMix64), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_R = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n; kept for the usual chunk size."""
    if n not in _powers:
        up = np.full(n, _R, dtype=np.uint64)
        down = np.full(n, pow(_R, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            made = np.cumprod(up), np.cumprod(down)
        if n > 2 * CHUNK:
            return made
        _powers[n] = made
    return _powers[n]


def _hash_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of a buffer."""
    a = np.frombuffer(buf, dtype=np.uint8)
    inside = ~SPACE[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(a) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(a) and inside[-1]:
        edge = np.concatenate((edge, [len(a)]))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    up, down = _power(max(CHUNK, len(a)))
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return start, mix64(h)


def hash_words(buf: bytes) -> np.ndarray:
    """64-bit hash of each word of a buffer."""
    with np.errstate(over="ignore"):
        return _hash_words(buf)[1]


def _shingle_chunk(texts: list[bytes], k: int) -> list[np.ndarray]:
    buf = b" ".join(texts).translate(LOWER)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    start, word = _hash_words(buf)
    bound = np.searchsorted(start, at)
    factor = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(word)
    if n >= k:
        rolled = word[: n - k + 1] * factor[0]
        for j in range(1, k):
            rolled += word[j : n - k + 1 + j] * factor[j]
        rolled = mix64(rolled)
    out = []
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if hi - lo >= k:
            h = np.sort(rolled[lo : hi - k + 1])
            new = np.empty(len(h), dtype=bool)
            new[0] = True
            np.not_equal(h[1:], h[:-1], out=new[1:])
            out.append(h[new])
        elif hi > lo:
            whole = np.array([np.uint64(hi - lo) * np.uint64(0xA24BAED4963EE407)], dtype=np.uint64)
            for j in range(lo, hi):
                whole += word[j] * factor[j - lo]
            out.append(mix64(whole))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: Iterable[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles.

    A text of fewer than k words has one, of all its words; one without words has none.
    """
    with np.errstate(over="ignore"):
        chunk, size = [], 0
        for t in texts:
            if chunk and size + len(t) + 1 > CHUNK:
                yield from _shingle_chunk(chunk, k)
                chunk, size = [], 0
            chunk.append(t)
            size += len(t) + 1
        if chunk:
            yield from _shingle_chunk(chunk, k)
