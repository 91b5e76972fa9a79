"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a text (lengths, shares of kinds of characters and words, repetition) are standardised and mapped to
random cosine features, whose inner products approximate a Gaussian kernel. Ridge regression of the labels on them
needs only sums of products: each partition of labelled rows adds up its own, and the driver adds FIT_PARTITIONS such
sums (each a fixed size) and solves. Raw scores of labelled rows that did not take part in that fit are summed by bins;
pooling adjacent violators over the bins gives a function that rises from pool to pool; between two pools scores are
interpolated, so that close scores keep their order.

Labels come from rows whose crc32(id as text) mod 5 is not 0; remainders 1 to 3 fit, 4 calibrates. At most MOST_LABELS of
them are used, chosen by a hash of the id: that is the one bound, and it does not touch scoring. Language, source, id
and labels are no input of a score.

Defined cases: null text counts as empty; empty texts have statistics of 0 and a score like any other; rows with
several labels count with their mean, null labels not at all; without labels of both kinds every score is the mean
label, or 0.5 if there is none. Ids are whole
numbers; others are an error (a null where ANSI mode is off). Other columns are not read, except those that a caller keeps.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_LABELS, FIT_PARTITIONS = 200_000, 16
FEATURES, RIDGE, BINS = 256, 1e-3, 512
KEEP_FROM = 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other symbols, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 beyond ASCII, 7 !
for _c in range(256):
    _CLASS[_c] = 6 if _c > 127 else 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 4 if chr(_c).isspace() else 7 if chr(_c) == "!" else 5 if chr(_c) in ".,;:'\"?()-" else 0
_END = str.isalnum

NAMES = (
    "log_chars log_words word_mean word_sd symbols lower upper digits spaces marks non_ascii shouts entropy distinct distinct_root most_common repeats odd_ends "
    "upper_words title_words log_lines line_mean distinct_lines letters_per_word short_words"
).split()


def statistics(text: str | None) -> list[float]:
    """The statistics in NAMES of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    if not data:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=8) / len(data)
    p = counts[counts > 0] / len(data)
    words = text.split()
    n = len(words) or 1
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    times = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    odd = upper = title = 0
    for w, k in times.items():
        last = w[-1]
        if not (last.isalnum() or last in ".,;:?'\")"):
            odd += k
        if w.isupper() and len(w) > 1:
            upper += k
        elif w[0].isupper():
            title += k
    lines = text.split("\n")
    return [
        math.log1p(len(text)), math.log1p(n), float(lengths.mean()), float(lengths.std()), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        float(-(p * np.log2(p)).sum()), len(times) / n, len(times) / math.sqrt(n), max(times.values(), default=0) / n, repeats / n, odd / n, upper / n, title / n,
        math.log1p(len(lines)), math.log1p(len(text) / len(lines)), len(set(lines)) / len(lines), float((lengths > 12).mean()), float((lengths < 3).mean()),
    ]


def fold(id_col: Column) -> Column:
    """crc32(id as text) mod 5; 0 is held out."""
    return (F.crc32(id_col.cast("string").cast("binary")) % 5).cast("int")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x (the statistics) for each row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_measure, "id long, x array<double>")


@dataclass
class Model:
    """All that scoring needs; its size does not depend on the data's."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        w, b = _directions(x.shape[1])
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.project(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.round(np.clip(np.interp(self.raw(x), self.edges, self.values), 0, 1), 6)


def _directions(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies of a Gaussian kernel of width sqrt(d), and phases; the same on every machine."""
    r = np.random.default_rng(1729)
    return r.normal(size=(d, FEATURES)) / math.sqrt(d), r.uniform(0, 2 * math.pi, FEATURES)


def pool(score: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators of points in rising score: (score, value) at both ends of each pool."""
    pools: list[list[float]] = []
    for s, w, m in zip(score, weight, mean, strict=True):
        pools.append([s, s, w, m])
        while len(pools) > 1 and pools[-2][3] >= pools[-1][3]:
            s1, e1, w1, m1 = pools.pop()
            s0, _, w0, m0 = pools.pop()
            pools.append([s0, e1, w0 + w1, (w0 * m0 + w1 * m1) / (w0 + w1)])
    return np.array([x for p in pools for x in p[:2]]), np.array([p[3] for p in pools for _ in range(2)])


def _frame(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = b.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), b.column("y").to_numpy(zero_copy_only=False)


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id, x, y, fold for the labelled rows that may be learned from, at most about MOST_LABELS."""
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    y = y.groupBy("id").agg(F.avg("y").alias("y")).withColumn("fold", fold(F.col("id"))).filter("fold <> 0")
    share = min(1.0, MOST_LABELS / max(1, y.count()))
    if share < 1:
        y = y.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return stats.join(y, "id")


def fit(rows: DataFrame) -> Model:
    """A model from labelled rows (id, x, y, fold)."""
    d = len(NAMES)
    rows = cut(rows.select("id", "x", "y", "fold"), "quality-rows")
    train, rest = rows.filter("fold in (1, 2, 3)"), rows.filter("fold = 4")
    told = rows.agg(F.avg("y"), F.min("y"), F.max("y")).first()
    sums = train.agg(*[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d)], F.count("*").alias("n")).first()
    model = Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not sums["n"] or told[1] == told[2] or rest.isEmpty():
        model.constant = 0.5 if told[0] is None else round(told[0], 6)
        return model
    model.mean = np.array([sums[f"m{k}"] for k in range(d)]).astype(np.float32).astype(float)
    model.scale = np.array([sums[f"s{k}"] or 1.0 for k in range(d)]).astype(np.float32).astype(float)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, zy, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for b in batches:
            if len(b):
                x, y = _frame(b)
                z = model.project(x)
                zz += z.T @ z
                zy += z.T @ y
                n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["zz", "zy", "n"])

    parts = train.coalesce(FIT_PARTITIONS).sortWithinPartitions("id").mapInArrow(add, "zz binary, zy binary, n long").collect()
    zz = sum(np.frombuffer(p["zz"]).reshape(FEATURES + 1, -1) for p in parts)
    zy, n = sum(np.frombuffer(p["zy"]) for p in parts), sum(p["n"] for p in parts)
    model.weights = np.linalg.solve(zz + RIDGE * n / FEATURES * np.eye(FEATURES + 1), zy)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = _frame(b)
                k = np.clip(np.floor((model.raw(x) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(y.astype(float))], names=["bin", "y"])

    cells = rest.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()
    at = np.array([(c["bin"] + 0.5) / BINS * 2 - 0.5 for c in cells])
    model.edges, model.values = pool(at, np.array([c["n"] for c in cells], float), np.array([c["s"] / c["n"] for c in cells]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """id, score for rows of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            s = model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64())], names=["id", "score"])

    return stats.mapInArrow(run, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    stats = cut(measured(docs), "quality-stats")
    model = fit(labelled(stats, labels))
    out = score(stats, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps; the columns of docs.

    Statistics of all rows go to a table for the fit; texts are measured again when they are filtered, which costs less
    than to shuffle them.
    """
    model = fit(labelled(cut(measured(docs), "quality-stats"), labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                s = model.score(np.array([statistics(x.as_py()) for x in b.column(at)]))
                yield b.filter(pa.array(s >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
