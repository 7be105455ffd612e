"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in what a text holds of a list of stems (words and beginnings of words): whether it has words
of a stem at all, twice, three times, and in what share of all words. Stems come from P alone: those that mark it off from U. It is fitted in numpy from texts confirmed as toxic (P) and texts
without a known label (U). With p the share of toxic texts, the risk is

    p * E_P[loss(+1)] + max(0, E_U[loss(-1)] - p * E_P[loss(-1)])

Where the second term falls below zero, the step goes against it, which keeps the fit from turning unlabelled texts that look
like P into confident negatives. P and U are bounded samples (MAX_P, MAX_U); every text is scored, as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldloom.llm.common import map_batches, row_hash, written

#: Bounds of the samples of labelled and of other rows that the classifier is fitted on.
MAX_P, MAX_U = 4_000, 12_000
#: A stem is looked at if so many texts of P have it, and kept if its share in P exceeds that in U by so many deviations.
LEAST_TEXTS, LEAST_DEVIATIONS = 4, 5.0
EPOCHS, BATCH, RATE, DECAY = 40, 512, 0.02, 1e-3
#: Lengths of beginnings of words.
BEGINNINGS = (4, 5, 6, 7)
#: Words from so many letters on, and text without spaces, count by what begins at any of their letters; so many letters of
#: them count as a word.
LONG_WORD, LETTERS = 40, 6
LEVELS = 5
REMEMBERED = 200_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def stems(word: bytes) -> Iterator[str]:
    """A word and its beginnings, the latter marked by a star; of a long word what may be the beginning of a word, at every letter."""
    w = word.decode("utf-8", "replace").lower()
    if len(w) < LONG_WORD:
        yield w
    for i in range(len(w) if len(w) >= LONG_WORD else 1):
        for k in BEGINNINGS:
            if len(w) >= i + k:
                yield w[i : i + k] + "*"


def word_count(found: list[bytes]) -> int:
    """Words of a text, a long one counting by its letters."""
    if not found or max(map(len, found)) < LONG_WORD:
        return len(found)
    letters = [len(w.decode("utf-8", "replace")) for w in found if len(w) >= LONG_WORD]
    return len(found) + sum(n // LETTERS - 1 for n in letters if n >= LONG_WORD)


def levels(count: int, n: int) -> int:
    """What count words of a stem among n say, as bits: any, two, three, one in 300, one in 100."""
    return 1 | (count >= 2) << 1 | (count >= 3) << 2 | (count >= 2 and count * 300 >= n) << 3 | (count >= 2 and count * 100 >= n) << 4


class Reader:
    """Finds the stems of a list in texts; remembers which of them a word has."""

    def __init__(self, listed: list[str]) -> None:
        self.number = {s: k for k, s in enumerate(listed)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = tuple(self.number[s] for s in stems(word) if s in self.number)
            if len(self.known) < REMEMBERED and len(word) < LONG_WORD:
                self.known[word] = got
        return got

    def features(self, text: bytes | None) -> list[int]:
        """Sorted numbers LEVELS * stem + level of all that holds of a text."""
        found, counts = text_words(text), {}
        for w in found:
            for k in self._of(w):
                counts[k] = counts.get(k, 0) + 1
        n = word_count(found)
        return sorted(LEVELS * k + i for k, c in counts.items() for i in range(LEVELS) if levels(c, n) >> i & 1)


@dataclass(frozen=True)
class Model:
    stems: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def fit_nnpu(rows_p: list[np.ndarray], rows_u: list[np.ndarray], n_words: int, prior: float, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias; a row has the numbers of its words. Logistic loss, minibatches of P and U, Adam."""
    rng, w, b = np.random.default_rng(seed), np.zeros(n_words), np.log(prior / (1 - prior))
    m, v, t = np.zeros(n_words + 1), np.zeros(n_words + 1), 0

    def scores(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return np.bincount(owner, w[flat], len(rows)) + b, flat, owner

    def gradient(flat: np.ndarray, owner: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(flat, slope[owner], n_words), slope.sum())

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    steps = max(1, len(rows_u) // BATCH)
    for _ in range(EPOCHS):
        order_p, order_u = rng.permutation(len(rows_p)), rng.permutation(len(rows_u))
        for s in range(steps):
            batch_p = [rows_p[i] for i in order_p[s::steps]] or [rows_p[i] for i in order_p[:1]]
            batch_u = [rows_u[i] for i in order_u[s::steps]]
            zp, fp, op = scores(batch_p)
            zu, fu, ou = scores(batch_u)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            unlabelled = gradient(fu, ou, sigmoid(zu) / len(zu)) - gradient(fp, op, prior * sigmoid(zp) / len(zp))
            positive = gradient(fp, op, prior * (sigmoid(zp) - 1) / len(zp))
            g = positive + unlabelled if negative >= 0 else -unlabelled
            g[:-1] += DECAY * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1) -> Model:
    """Fits the model on at most MAX_P confirmed toxic texts and MAX_U others, all outside the held-out fold.

    Samples are the rows with the smallest hashes of their keys; rows that are equal in key and text count once. Labels of 0 only
    enter the estimate of the share of toxic texts. Without any confirmed text the model scores everything near 0.
    """
    order = lambda *more: [F.xxhash64("key", F.lit(seed)), "key", *more]
    row = docs.select(F.col(key).alias("key"), row_hash(F.col(text)).alias("row"))
    rows_of = lambda d, n: d.distinct().orderBy(*order("row")).limit(n)
    fold = labels.filter(F.col(key).isNotNull() & ~held_out(F.col(key)))
    share = fold.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    if not share:
        return Model((), (), -10.0)
    confirmed = fold.filter("toxic = 1").select(F.col(key).alias("key")).distinct().orderBy(*order()).limit(MAX_P)
    sides = rows_of(row.join(F.broadcast(confirmed), "key"), MAX_P), rows_of(row.filter(F.col("key").isNotNull() & ~held_out(F.col("key"))), MAX_U)
    # Both lists are bounded by MAX_P and MAX_U rows.
    chosen = F.broadcast(written(sides[0].withColumn("p", F.lit(True)).unionByName(sides[1].withColumn("p", F.lit(False))), "chosen"))
    texts = docs.select(F.col(key).alias("key"), row_hash(F.col(text)).alias("row"), F.col(text).cast("binary").alias("text"))
    rows = written(texts.join(chosen, ["key", "row"]).groupBy("key", "row", "p").agg(F.first("text").alias("text")).select("p", "text"), "sample")

    def stems_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(s for t in batch.column(1) for s in {s for w in set(text_words(t.as_py())) for s in stems(w)})
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array([*found.values()], pa.int64())], ["stem", "n"])

    counts = rows.filter("p").mapInArrow(stems_of, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    seen = [r["stem"] for r in counts.orderBy(F.desc("n"), "stem").collect()]  # stems of LEAST_TEXTS of MAX_P texts

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seen)
        for batch in batches:
            for side in (True, False):
                own = batch.filter(pc.equal(batch.column(0), side))
                found = Counter(f for t in own.column(1) for f in reader.features(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([side] * (len(found) + 1)), pa.array([-1, *found], pa.int64()), pa.array([own.num_rows, *found.values()], pa.int64())], ["p", "feature", "n"])

    sums = rows.mapInArrow(features_of, "p boolean, feature long, n long").groupBy("p", "feature").agg(F.sum("n").alias("n")).toArrow()  # LEVELS per stem
    held = {True: np.zeros(LEVELS * len(seen) + 1), False: np.zeros(LEVELS * len(seen) + 1)}
    for p, feature, n in zip(*(c.to_pylist() for c in sums.columns)):
        held[p][feature] = n
    kept = marking(*(held[p] for p in (True, False)))
    if not held[True][-1] or not held[False][-1] or not len(kept):
        return Model((), (), -10.0)
    marks = np.full(LEVELS * len(seen), -1)
    marks[kept] = np.arange(len(kept))

    def make():
        reader = Reader(seen)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = (marks[reader.features(t)] if t else np.zeros(0, np.int64) for t in (x.as_py() for x in batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[f >= 0].astype("<i4").tobytes() for f in found], pa.binary())], ["p", "found"])

        return step

    got = map_batches(rows, "p boolean, found binary", make).toArrow()  # the sample, of each text what it has of the kept features
    sides = got.column("p").to_pylist()
    rows_p, rows_u = ([np.frombuffer(f, "<i4") for f in sorted(x.as_py() for x, side in zip(got.column("found"), sides) if side == p)] for p in (True, False))
    w, b = fit_nnpu(rows_p, rows_u, len(kept), min(max(share, 1e-3), 0.9), seed)
    used = sorted({int(k) // LEVELS for k in kept})
    full = dict(zip(kept.tolist(), w.tolist()))
    return Model(tuple(seen[k] for k in used), tuple(full.get(LEVELS * k + i, 0.0) for k in used for i in range(LEVELS)), b)


def marking(in_p: np.ndarray, in_u: np.ndarray) -> np.ndarray:
    """Features whose share in P exceeds that in U clearly. Both arrays hold how many texts have each feature, and last how many texts there are."""
    n_p, n_u = max(in_p[-1], 1), max(in_u[-1], 1)
    p, u = in_p[:-1] / n_p, in_u[:-1] / n_u
    both = (in_p[:-1] + in_u[:-1]) / (n_p + n_u)
    z = (p - u) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_p + 1 / n_u))
    return np.flatnonzero((z >= LEAST_DEVIATIONS) & (p >= 2 * u))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key and score (0 to 1).

    Null and empty texts get the score of a text without words. Repeated rows give repeated rows, an empty table an empty
    result, other columns are left out. The model, bounded by the words of MAX_P texts, travels with the tasks.
    """
    return with_score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, "text", "score").select(F.col("key").alias(key), "score")


def with_score(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """docs with a further column, the score."""
    at = docs.columns.index(text)

    def make():
        reader, weights = Reader(list(model.stems)), np.array([*model.weights, 0.0])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = (t.encode("utf-8", "replace") if t else None for t in (x.as_py() for x in batch.column(at)))
            z = [model.bias + float(weights[reader.features(t) or [-1]].sum()) if t else model.bias for t in texts]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*batch.schema.names, name])

        return step

    return map_batches(docs, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]), make)
