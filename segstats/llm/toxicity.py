"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries share the frequent words of ordinary text.  The toxic one is
completed with the windows that toxic documents hold far more often than
ordinary ones, the most frequent nearest to what is compressed, the ordinary one
with as many bytes of ordinary windows.  (Their content is chosen here and not
by the library's own trainer: that cuts words into segments, and classed far
fewer toxic documents.)  A window (a word without ASCII marks, in a fixed frame
that both dictionaries hold, so that its cost is not hidden by the raw form of
short blocks) is compressed with both; the gain is the difference of the two
lengths.  How many windows of a document gain how much decides, through a
logistic curve fitted on labelled rows.

Bounds: ``sample`` documents of each label, first in hash order, train the
dictionaries and the curve; weights restore the shares of all labelled rows.  Of
rows that repeat a sampled doc_id the text with the smallest SHA-256 is used.
Whole sampled texts count; near copies of a sampled text are left out of the
counts, the shared part is the 300 most frequent ordinary words and the own part
of a dictionary at most 4 KB.  Every word of every text is scored.

Defined results: null text is empty and scored as a text without windows;
without labels of both kinds every score is the share of toxic labels (0 if
there is none); rows that repeat are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh

SAMPLE = 3000
THRESHOLD = 0.7
GAINS = (1, 2, 3, 4, 5, 6)
FRAME = b" |0123456789abcdefghijklmnopqrstuvwxyz|"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words longer than this are several windows; windows whose gain a worker remembers.
LONGEST, REMEMBERED = 48, 400_000
_PARAMETERS = {"window_log": 12, "hash_log": 12, "chain_log": 12, "search_log": 6, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY2}


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 3; rows of fold 1 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def windows(text: bytes) -> list[bytes]:
    words = text.lower().translate(None, MARKS).split()
    if len(text) > LONGEST and max(map(len, words), default=0) > LONGEST:
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: float = 0.0

    def gains(self) -> Gains:
        return Gains(self)

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.coefficients):
            return np.full(len(features), self.share)
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -40, 40)))


class Gains:
    """Gain of windows, remembered."""

    def __init__(self, model: Model):
        self.known: dict[bytes, int] = {}
        self.pair = []
        for content in (model.ordinary, model.toxic):
            data = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **_PARAMETERS)
            data.precompute_compress(compression_params=how)
            self.pair.append(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress)

    def of(self, window: bytes) -> int:
        framed = b" " + window + FRAME
        return len(self.pair[0](framed)) - len(self.pair[1](framed))

    def features(self, text: bytes) -> list[float]:
        found = windows(text)
        got = list(map(self.known.get, found))
        if None in got:
            new = {w: self.of(w) for w in {w for w, g in zip(found, got) if g is None}}
            got = [new[w] if g is None else g for w, g in zip(found, got)]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known.update(new)
        counts = Counter(got)
        above = [sum(n for g, n in counts.items() if g >= t) for t in GAINS]
        return [1.0, np.log1p(len(found)), *np.log1p(above)]


# ---------------------------------------------------------------- training


def _unlike(texts: list[bytes]) -> list[bytes]:
    """Texts without near copies of earlier ones, by their twelve smallest word-pair hashes."""
    seen, out = set(), []
    for text in texts:
        words = text.lower().split()
        marks = sorted({zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])})[:12]
        if sum(m in seen for m in marks) < 3:
            seen.update(marks)
            out.append(text)
    return out


def _content(words: list[bytes], size: int) -> bytes:
    """Raw content of a dictionary, the last word nearest to what is compressed."""
    return (b" " + b" ".join(dict.fromkeys(words)) + b" ")[-size:]


def _starts(windows_of_text: set[bytes]) -> set[bytes]:
    """The windows and their beginnings of 4 to 8 bytes."""
    return windows_of_text | {w[:n] for w in windows_of_text for n in range(4, min(8, len(w) - 1) + 1)}


def _standing_out(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, int]:
    """Windows, and beginnings of them, at least e^2 times as frequent among toxic documents, with the number of documents.

    Counts enter with two standard deviations of doubt.  A beginning is left out where one longer form stands in as many documents.
    """
    t = Counter(w for x in toxic for w in _starts(set(windows(x))))
    least = max(5, len(toxic) // 100)
    often = {w for w, n in t.items() if n >= least}
    o = Counter(w for x in ordinary for w in _starts(set(windows(x))) & often)
    share = (len(ordinary) + 1) / (len(toxic) + 1)
    out = {w: t[w] for w in often if (t[w] - 2 * t[w] ** 0.5) / (o[w] + 2 * o[w] ** 0.5 + 2) * share > np.e**2}
    shorter = {w[:n] for w in out for n in range(4, len(w)) if out.get(w[:n]) == out[w]}
    return {w: n for w, n in out.items() if w not in shorter}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * weight.sum() / len(weight))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[bytes], ordinary: list[bytes], n_toxic: int, n_ordinary: int) -> Model:
    """A model from sampled texts of both labels and the counts of all labelled rows."""
    total = n_toxic + n_ordinary
    model = Model(share=n_toxic / total if total else 0.0)
    if not toxic or not ordinary:
        return model
    t, o = _unlike(toxic), _unlike(ordinary)
    out = _standing_out(t, o)
    common = [w for w, _ in Counter(w for x in o for w in set(windows(x))).most_common(300 + 2000) if w not in out]
    base = b" ".join(reversed(common[:300]))
    content = _content([w for w, _ in sorted(out.items(), key=lambda i: (i[1], i[0]))], 1 << 12)
    model.toxic, model.ordinary = base + content, base + _content(list(reversed(common[300:])), len(content))
    gains = model.gains()
    x = np.array([gains.features(text) for text in [*toxic, *ordinary]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    weight = np.r_[np.full(len(toxic), n_toxic / len(toxic)), np.full(len(ordinary), n_ordinary / len(ordinary))]
    model.coefficients = logistic(x, y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on the labelled rows outside fold 1; at most ``sample`` documents of each label come to the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = {}
    for mark in (True, False):
        chosen = known.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # sample rows at most
        rows = rows.groupBy("doc_id").agg(F.min_by("text", F.coalesce(F.sha2("text", 256), F.lit(""))).alias("text"))  # one text of each, whatever repeats
        found = {r["doc_id"]: (r["text"] or "").encode() for r in rows.collect()}
        texts[mark] = [found[d] for d in sorted(found)]
    return train(texts[True], texts[False], counts.get(True, 0), counts.get(False, 0))


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score of their text added."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        for batch in batches:
            rows = [gains.features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(at)]
            scores = model.scores(np.array(rows).reshape(len(rows), -1))
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not classed as toxic, with all their columns."""
    (mark,) = fresh(docs, "_score")
    scored = score(docs, fit(docs, labels), mark)
    return scored.where(F.col(mark) < threshold).select(*docs.columns)
