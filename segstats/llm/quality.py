"""Quality by kernel ridge regression on document statistics.

Each text is reduced to some twenty statistics.  Random Fourier features stand
for a Gaussian kernel on their standardised values: cos(W x + b) with normal W.
Every partition of the labelled rows adds up its own normal equations, Spark adds
the partitions, and the driver solves one system as large as the number of
features.  Raw scores are calibrated by isotonic regression over counts in score
bins.

All labelled rows outside fold 1 are learned from; what reaches the driver is
one system and one histogram, whatever their number.

Defined results: null text is empty and has statistics of zeros; without labels
every score is 0.5, with labels of one kind it is their value; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.toxicity import fold
from segstats.scale import settle

FEATURES = 192
WIDTH = 1.5
RIDGE = 1e-3
BINS = 400
SEED = 42
THRESHOLD = 0.5
STATISTICS = ("log_bytes", "log_words", "word_length", "upper", "digits", "other_ascii", "marks", "not_ascii", "bars", "stops", "commas", "line_ends",
              "distinct_words", "top_word", "same_as_last", "distinct_pairs", "distinct_lines", "line_words", "short_words", "long_words", "marked_words", "shouted_words")

_KIND = np.zeros(256, np.int64)
for _name, _codes in enumerate([range(65, 91), range(97, 123), range(48, 58), [32, 9, 11, 12, 13], [10], map(ord, "#$%&*"), map(ord, "!"), map(ord, "|"), map(ord, ".?"), map(ord, ","), range(128, 256)], 1):
    _KIND[list(_codes)] = _name


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a whole text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=12)
    other, upper, _, digits, spaces, ends, marks, shouts, bars, stops, commas, wide = kinds.tolist()
    n, size = len(words), len(text)
    letters = max(1, size - spaces - ends)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(map(bytes.endswith, words, [(b"#", b"$", b"%", b"&", b"*", b"|")] * n))
    shouted = sum(map(bytes.endswith, words, [b"!"] * n))
    return [np.log1p(size), np.log1p(n), letters / n, upper / letters, digits / letters, other / letters, (marks + shouts) / letters, wide / letters, bars / n, stops / n, commas / n,
            ends / n, len(counts) / n, max(counts.values()) / n, same / n, len(pairs) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            float((sizes <= 3).mean()), float((sizes >= 12).mean()), marked / n, shouted / n]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics; the text goes no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    prior: float = 0.5
    seed: int = SEED

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, and the constant."""
        rng = np.random.default_rng(self.seed)
        d = stats.shape[1]
        w = rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        raw = self.raw(stats)
        if self.knots is None:
            return np.clip(raw, 0, 1)
        # A trace of the raw score keeps the order inside the flat parts.
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def _stats_of(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit along rising ``x`` by pooling of adjacent violators."""
    blocks: list[list[float]] = []
    for value, w in zip(y[np.argsort(x, kind="stable")], weight[np.argsort(x, kind="stable")]):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * u) / (blocks[-1][1] + u), blocks[-1][1] + u, blocks[-1][2] + k]
    return np.concatenate([np.full(k, v) for v, _, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``stats`` (doc_id, stats) joined to the labels outside fold 1."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("good"))
    known = known.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("good").alias("good"))
    rows = settle(stats.join(known, "doc_id").select("stats", "good"))
    moments = rows.select("good", F.posexplode("stats").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"), F.avg("good").alias("share")).orderBy("i").collect()  # a row for each statistic
    model = Model()
    if not moments:
        return model
    model.prior = moments[0]["share"]
    if model.prior in (0.0, 1.0):
        return model
    model.mean = np.array([m["mean"] for m in moments])
    model.scale = np.maximum([m["scale"] for m in moments], 1e-6)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_stats_of(batch))
            total += z.T @ np.hstack([z, batch.column("good").to_numpy()[:, None]])
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(model.raw(_stats_of(batch))), batch.column("good")], names=["raw", "good"])

    sums = rows.mapInArrow(equations, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # one system
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in sums:
        system[r["i"], r["j"]] = r["v"]
    n = system[-1, -2]
    model.weights = np.linalg.solve(system[:, :-1] + RIDGE * n * np.diag(np.r_[np.full(FEATURES, 1 / FEATURES), 0.0]) + 1e-9 * np.eye(FEATURES + 1), system[:, -1])
    bin_of = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2))
    bins = rows.mapInArrow(lookup, "raw double, good double").groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("good").alias("good")).orderBy("raw").collect()  # BINS + 1 rows at most
    x, y, w = (np.array([r[c] for r in bins], float) for c in ("raw", "good", "n"))
    model.knots = (x, isotonic(x, y, w))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with a score in place of the statistics."""
    names = [c for c in stats.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(model.scores(_stats_of(batch)), pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "stats")
    return stats.mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = settle(with_statistics(docs))
    scored = score(stats, fit(stats, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
