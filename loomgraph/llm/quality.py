"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Method: a text becomes a set of hashed features, shared by all grades: its words, their first four and five and last three
bytes, and bands of a few shares (capitals, symbols, repeated words and lines, word length, size). One weight vector w
gives a score s, and ordered thresholds b_1 < b_2 < ... give P(grade >= k) = logistic(s - b_k). Weights and thresholds
are fitted together to the likelihood of the ratings, with AdaGrad steps and an L1 pull that keeps weights of chance
features at zero. The expected grade is the sum of the tail probabilities; the probability of the highest tail selects.

The fit uses at most ``sample`` rated documents, those whose ids hash lowest; features are made on the executors and only
they reach the driver. Scoring is one narrow pass over whole texts.

Defined results: a text that is null or has no words gets grade 0 and probability 0 and is rejected. With ratings of fewer
than two grades nothing can be learnt: grade and probability are null and every text with words is kept. Of several ratings of one id the
lowest counts; ratings with a null are not used. Repeated rows each get the same answer; columns besides those named are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashed features.
SIZE = 1 << 18
#: Rated documents that a fit uses, at most, and the features that they may have together (4 bytes each on the driver).
SAMPLE, SAMPLE_FEATURES = 16_000, 32_000_000
#: Columns that scoring adds.
SCORES = ("expected_grade", "tail_probability", "keep")
EPOCHS, BATCH, RATE, L1 = 12, 128, 0.4, 2e-4


@dataclass
class Model:
    weights: np.ndarray  # float32[SIZE]
    thresholds: np.ndarray  # ascending, one for each grade above the lowest

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: [texts, thresholds]."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def _band(share: float, cuts: tuple[float, ...]) -> int:
    return int(np.searchsorted(cuts, share, side="right"))


_SHARES = (0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9)
_LONG = (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 14.0)
_MANY = (5, 20, 50, 200, 1000, 5000)


def _whole_text(text: bytes, words: int, distinct: int) -> list[tuple[int, int]]:
    """(kind, band) of the shares of a whole text."""
    n = max(1, len(text) - text.count(b" ") - text.count(b"\n"))
    a = np.frombuffer(text, dtype=np.uint8)
    letters = int(np.count_nonzero(((a | 32) >= 97) & ((a | 32) <= 122)))
    capitals = int(np.count_nonzero((a >= 65) & (a <= 90)))
    high = int(np.count_nonzero(a >= 128))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        (1, _band(capitals / max(1, letters), _SHARES)),
        (2, _band(1 - (letters + high) / n, _SHARES)),
        (3, _band(1 - distinct / words, _SHARES)),
        (4, _band(1 - len(set(lines)) / max(1, len(lines)), _SHARES)),
        (5, _band(n / words, _LONG)),
        (6, _band(words, _MANY)),
        (7, _band(text.count(b" | ") / words, _SHARES)),
        (8, _band(1 - distinct / words, _SHARES) * 8 + _band(words, _MANY)),
    ]


def _chunk(texts: list[bytes]) -> list[np.ndarray]:
    raw = b" ".join(texts)
    buf = np.frombuffer(raw.translate(common.LOWER), dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    inside = np.concatenate(([False], ~common.SPACE[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = common._power(max(common.CHUNK, len(buf)))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])

    def feature(kind: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind * 0x632BE59BD9B4E019 % (1 << 64))
        return (common.mix64(h) % np.uint64(SIZE)).astype(np.int32)

    columns = np.stack([feature(1, start, end), feature(2, start, np.minimum(start + 4, end)), feature(3, start, np.minimum(start + 5, end)), feature(4, np.maximum(end - 3, start), end)]) if len(start) else np.zeros((4, 0), dtype=np.int32)
    bound = np.searchsorted(start, at)
    out = []
    for i, text in enumerate(texts):
        lo, hi = int(bound[i]), int(bound[i + 1])
        if lo == hi:
            out.append(np.zeros(0, dtype=np.int32))
            continue
        shares = _whole_text(text, hi - lo, len(np.unique(columns[0, lo:hi])))
        extra = common.mix64(np.array([kind << 32 | band for kind, band in shares], dtype=np.uint64) + np.uint64(0xA0761D6478BD642F)) % np.uint64(SIZE)
        out.append(np.unique(np.concatenate((columns[:, lo:hi].ravel(), extra.astype(np.int32)))))
    return out


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashed features of each text; none without words."""
    out, chunk, size = [], [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            if chunk and size + len(t) + 1 > common.CHUNK:
                out += _chunk(chunk)
                chunk, size = [], 0
            chunk.append(t)
            size += len(t) + 1
        if chunk:
            out += _chunk(chunk)
    return out


def slopes(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the weighted negative log-likelihood by each text's score and by each threshold, where P(grade = k) = s(score - b_k) - s(score - b_k+1), s the logistic function."""
    edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
    above = 1 / (1 + np.exp(-np.clip(score - edges[grades], -40, 40)))
    over = 1 / (1 + np.exp(-np.clip(score - edges[grades + 1], -40, 40)))
    width = np.maximum(above - over, 1e-9)
    by_threshold = np.zeros(len(edges))
    np.add.at(by_threshold, grades, weight * above * (1 - above) / width)
    np.add.at(by_threshold, grades + 1, -weight * over * (1 - over) / width)
    return -(1 - above - over) * weight, by_threshold[1:-1]


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, seed: int = 7) -> Model | None:
    """The model of featured texts and their grades 0, 1, ...; None if there are fewer than two grades."""
    top = int(grades.max()) if len(grades) else 0
    if len(np.unique(grades)) < 2:
        return None
    share = np.clip([(grades >= k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    b = -np.log(share / (1 - share))
    b = np.maximum.accumulate(b + 1e-2 * np.arange(top))
    w, seen = np.zeros(SIZE), np.zeros(SIZE)
    b_seen = np.zeros(top)
    rng = np.random.default_rng(seed)
    often = np.bincount(grades, minlength=top + 1)
    weight = np.sqrt(len(grades) / np.maximum(often, 1) / (top + 1))  # rare grades count for more
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in pick])
            flat = np.concatenate([rows[i] for i in pick])
            text = np.repeat(np.arange(len(pick)), sizes)
            scale = 1 / np.sqrt(np.maximum(sizes, 50) / 50)
            s = np.bincount(text, w[flat], minlength=len(pick)) * scale
            y = grades[pick]
            slope, gb = slopes(s, b, y, weight[y])
            used, where = np.unique(flat, return_inverse=True)
            g = np.bincount(where, (slope * scale)[text], minlength=len(used)) / len(pick)
            seen[used] += g * g
            step = RATE / (np.sqrt(seen[used]) + 1e-8)
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
            gb /= len(pick)
            b_seen += gb * gb
            b = np.maximum.accumulate(b - RATE / (np.sqrt(b_seen) + 1e-8) * gb + 0.0)
            b += 1e-3 * np.arange(top) * (np.diff(b, prepend=b[0] - 1) <= 0)
    return Model(w.astype(np.float32), b)


def score_arrays(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(rows))
    for i, r in enumerate(rows):
        out[i] = model.weights[r].sum(dtype=np.float64) / np.sqrt(max(len(r), 50) / 50)
    return out


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> Model | None:
    """Fit to rated documents; ratings hold ids and grades 0, 1, ...

    Of the ratings those whose ids hash lowest are used, at most ``sample``, and of these as many as have at most ``most`` features together, the first one at any rate. An id that comes
    with several texts counts once, with the least text.
    """
    common.ship(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade")).dropna().groupBy("_id").agg(F.min("_grade").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64("_id", F.lit("rated")), "_id").limit(sample)

    def run(batches):
        for b in batches:
            made = features([common.as_bytes(t) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], ["id", "grade", "n", "features"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")  # a row for each sampled rating at most
    texts = texts.groupBy("_id", "_grade").agg(F.min("_text").alias("_text"))
    made = common.saved(texts.select(F.xxhash64("_id", F.lit("rated")).alias("id"), "_grade", "_text").mapInArrow(run, "id long, grade int, n long, features binary").filter("n > 0"), "rated")
    # As many as fit, told by their sizes alone: a row of two numbers for each sampled rating.
    sizes = made.select("id", "n").toArrow()
    if not sizes.num_rows:
        return None
    ids, n = sizes["id"].to_numpy(), sizes["n"].to_numpy()
    order = np.lexsort((n, ids))
    taken = max(1, int(np.searchsorted(np.cumsum(n[order]), most, side="right")))
    got = made.filter(F.col("id") <= int(ids[order[taken - 1]])).drop("n").toArrow()
    rows: list[np.ndarray] = []
    for packed in got.column(2).chunks:  # views of the collected buffers: nothing is copied
        flat = np.frombuffer(packed.buffers()[2], dtype=np.int32)
        at = np.frombuffer(packed.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(packed.type) else np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
        rows += [flat[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    grades = got.column(1).to_numpy().astype(np.int64)
    order = np.lexsort(([len(r) for r in rows], grades, got.column(0).to_numpy())).tolist()  # the same whatever partitions came first
    return fit_arrays([rows[i] for i in order], grades[order])


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5, names: tuple[str, str, str] = SCORES) -> DataFrame:
    """All columns of docs and the expected grade, the probability of the highest grade, and whether it is at least that, under these names; columns of docs that have them are replaced."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)  # one weight vector of fixed size
    taken = dict(zip(names, ("double", "double", "boolean"), strict=True))
    columns = [c for c in docs.columns if c not in taken]
    where = columns.index(text_col)

    def run(batches):
        m = sent.value
        for b in batches:
            rows = features([common.as_bytes(t) for t in b.column(where).to_pylist()])
            full = np.array([len(r) > 0 for r in rows], dtype=bool)
            if m is None:
                grade = pa.array([None if f else 0.0 for f in full], pa.float64())
                tail, keep = grade, pa.array(full)
            else:
                tails = m.tails(score_arrays(m, rows)) * full[:, None]
                grade, tail, keep = pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, -1])), pa.array(full & (tails[:, -1] >= least))
            yield pa.RecordBatch.from_arrays([*b.columns, grade, tail, keep], [*columns, *taken])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    kinds = {"double": DoubleType(), "boolean": BooleanType()}
    schema = StructType([*(docs.schema[c] for c in columns), *(StructField(c, kinds[k]) for c, k in taken.items())])
    return docs.select(*columns).mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of binary labels: 0 poor, 1 fit to read but toxic, 2 good."""
    return labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.expr("CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END").alias("grade"))
