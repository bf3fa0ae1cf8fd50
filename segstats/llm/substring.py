"""Removal of repeated word sequences, found by fixed-block anchors.

A repeat of ``window`` words holds a whole block of ``(window + 1) / 2`` words
that starts at a multiple of that length in its own document, wherever it
stands in the other.  So every document puts its non-overlapping blocks in an
index, and every rolling window of the block length probes it.  A probe that
meets a block of another document is a hit; hits are extended to the windows of
``window`` words around them, and these are matched exactly by their own hashes
(64 bits, and the bits of an independent hash that choose the bucket).
Overlapping matches are the maximal exact repeats.

How it is dealt out: documents are grouped by a hash of doc_id into groups of
some MB of text.  A group sends each value to its bucket once, whatever the
number of its documents that hold it, and looks at its own repeats itself, so a
passage that a third of all documents share costs one entry per group.  Values
travel as sorted arrays.  The documents are shuffled once: the three passes over
them read the same exchange.

Defined results: null text has no words; words are not normalised; the row with
the smallest doc_id keeps the sequence, and all rows that share that doc_id; a
null doc_id counts as the smallest; a document never loses words to itself; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BYTES_PER_GROUP = 4_000_000
WORDS_PER_BUCKET = 2_000_000
_SMALLEST = -(2**63)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- words and windows


def _mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * factor
    return x ^ (x >> np.uint64(29))


class Chunk:
    """The documents of a group, sorted by doc_id, with all their words in one row."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in table.column("text")]
        order = sorted(range(len(ids)), key=lambda i: (_SMALLEST if ids[i] is None else ids[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.keys = np.array([_SMALLEST if d is None else d for d in self.ids], np.int64)
        self.words = [texts[i].split() for i in order]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        self.hashes = np.fromiter((h for words in self.words for h in map(xxhash.xxh64_intdigest, words)), np.uint64, n)
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.place = np.arange(n) - self.starts[self.doc] if n else np.zeros(0, np.int64)

    def rolling(self, width: int, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(positions, values) of every window of ``width`` words inside one document."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(n - width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                value = value * factor + self.hashes[j : n - width + 1 + j]
            value = _mixed(value, factor)
        at = np.flatnonzero(self.place[: n - width + 1] + width <= self.lengths[self.doc[: n - width + 1]])
        return at, value[at]


def _bytes(values: np.ndarray) -> bytes:
    """Sorted or small integers as bytes, equal places of all numbers side by side: the high places compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _differences(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[1:] -= values[:-1]
    return out


def _by_bucket(bucket: np.ndarray, n: int):
    """(bucket, rows) for the buckets that have rows; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    for b in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(b), order[ends[b - 1] if b else 0 : ends[b]]


# ---------------------------------------------------------------- the five steps


class Finder:
    def __init__(self, window: int = WINDOW, buckets: int = 64):
        if window < 3 or window % 2 == 0:
            raise ValueError("window must be odd, and 3 at least")
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets

    # Anchors: 32 bits inside the bucket; the lowest says whether the value is a block or only a probe.

    def _anchors(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, value = chunk.rolling(self.block, _P)
        return at, (value >> np.uint64(32)).astype(np.int64) % self.buckets, ((value & np.uint64(0xFFFFFFFF)) >> np.uint64(1)).astype(np.uint32)

    def send_anchors(self, table: pa.Table) -> pa.Table:
        """Per bucket the sorted distinct values of a group, with two marks: it is a block here, several documents here have it."""
        chunk, rows = Chunk(table), []
        group = table.column("group")[0].as_py()
        at, bucket, value = self._anchors(chunk)
        for b, mine in _by_bucket(bucket, self.buckets):
            mine = mine[np.argsort(value[mine], kind="stable")]
            v, doc = value[mine], chunk.doc[at[mine]]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            block = np.maximum.reduceat((chunk.place[at[mine]] % self.block == 0).astype(np.uint8), first)
            shared = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            rows.append((b, group, _bytes(_differences(v[first])), np.packbits(block).tobytes(), np.packbits(shared).tobytes()))
        return _table(rows, [("bucket", pa.int32()), ("group", pa.int64()), ("values", pa.binary()), ("blocks", pa.binary()), ("shared", pa.binary())])

    def match_anchors(self, table: pa.Table) -> pa.Table:
        """Per group the values that are a block somewhere and stand in two documents."""
        sent = [(g, np.cumsum(_numbers(v, "u4"), dtype=np.uint32), k, s) for g, v, k, s in zip(*(table.column(c).to_pylist() for c in ("group", "values", "blocks", "shared")))]
        values = np.concatenate([v for _, v, _, _ in sent])
        blocks = np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8), count=len(v)) for _, v, k, _ in sent])
        shared = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(v)) for _, v, _, s in sent])
        order = np.argsort(values, kind="stable")
        v = values[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        many = np.diff(np.r_[first, len(v)]) > 1
        hit = v[first][np.maximum.reduceat(blocks[order], first).astype(bool) & (many | np.maximum.reduceat(shared[order], first).astype(bool))]
        bucket, rows = table.column("bucket")[0].as_py(), []
        for group, mine, _, _ in sent:
            found = mine[np.isin(mine, hit, assume_unique=True)]
            if len(found):
                rows.append((group, bucket, _bytes(_differences(found))))
        return _table(rows, [("group", pa.int64()), ("bucket", pa.int32()), ("values", pa.binary())])

    # Windows: 64 bits, and a bucket from an independent hash.

    def _windows(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, value = chunk.rolling(self.window, _P)
        _, other = chunk.rolling(self.window, _Q)
        return at, (other >> np.uint64(32)).astype(np.int64) % self.buckets, value

    def send_windows(self, documents: pa.Table, hits: pa.Table) -> pa.Table:
        """Per bucket the windows around the hits of a group, each with the smallest doc_id that has it here."""
        if not documents.num_rows or not hits.num_rows:
            return _table([], _WINDOWS)
        chunk, rows = Chunk(documents), []
        group = documents.column("group")[0].as_py()
        at, bucket, value = self._anchors(chunk)
        known = np.concatenate([(np.int64(b) << 32) + np.cumsum(_numbers(v, "u4"), dtype=np.uint32) for b, v in zip(hits.column("bucket").to_pylist(), hits.column("values").to_pylist())])
        marked = np.zeros(len(chunk.hashes) + 1, np.int64)
        marked[at[np.isin((bucket << 32) + value, known)]] = 1
        # A window holds a hit if one of its first window - block + 1 words starts one.
        upto = np.r_[0, np.cumsum(marked)]
        wat, wbucket, wvalue = self._windows(chunk)
        near = np.flatnonzero(upto[np.minimum(wat + self.window - self.block + 1, len(marked))] > upto[wat])
        wat, wbucket, wvalue = wat[near], wbucket[near], wvalue[near]
        for b, mine in _by_bucket(wbucket, self.buckets):
            mine = mine[np.argsort(wvalue[mine], kind="stable")]  # equal values stay in order of doc_id
            v = wvalue[mine]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            rows.append((b, group, _bytes(v[first]), _bytes(chunk.keys[chunk.doc[wat[mine[first]]]])))
        return _table(rows, _WINDOWS)

    def match_windows(self, table: pa.Table) -> pa.Table:
        """Per group the windows that start in a document with a smaller doc_id elsewhere."""
        groups = table.column("group").to_pylist()
        values = [_numbers(v, "u8") for v in table.column("values").to_pylist()]
        keys = [_numbers(k, "i8") for k in table.column("keys").to_pylist()]
        v, k = np.concatenate(values), np.concatenate(keys)
        row = np.repeat(np.arange(len(groups)), [len(x) for x in values])
        order = np.lexsort((k, v))
        vs, ks = v[order], k[order]
        first = np.flatnonzero(np.r_[True, vs[1:] != vs[:-1]])
        least = np.repeat(ks[first], np.diff(np.r_[first, len(vs)]))
        lost = order[ks > least]
        rows, out = row[lost], []
        for r in np.unique(rows):
            out.append((groups[r], _bytes(np.sort(v[lost[rows == r]]))))
        return _table(out, [("group", pa.int64()), ("values", pa.binary())])

    def removed(self, chunk: Chunk, elsewhere: np.ndarray) -> np.ndarray:
        """Of each word of a group, whether it goes."""
        at, _, value = self._windows(chunk)
        gone = np.zeros(len(chunk.hashes) + 1, np.int64)
        if len(at):
            order = np.argsort(value, kind="stable")  # equal values stay in order of doc_id
            v = value[order]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            key = chunk.keys[chunk.doc[at[order]]]
            later = np.zeros(len(at), bool)
            later[order] = key > np.repeat(key[first], np.diff(np.r_[first, len(v)]))
            cut = at[later | np.isin(value, elsewhere)]
            np.add.at(gone, cut, 1)
            np.add.at(gone, cut + self.window, -1)
        return np.cumsum(gone)[:-1] > 0

    def finish(self, documents: pa.Table, lost: pa.Table) -> pa.Table:
        """Per document its words, its repeats and what is left."""
        if not documents.num_rows:
            return _table([], _RESULT)
        chunk, rows = Chunk(documents), []
        elsewhere = [_numbers(v, "u8") for v in lost.column("values").to_pylist()]
        gone = self.removed(chunk, np.concatenate(elsewhere) if elsewhere else np.zeros(0, np.uint64))
        for i, doc_id in enumerate(chunk.ids):
            mine = gone[chunk.starts[i] : chunk.starts[i] + chunk.lengths[i]]
            words = chunk.words[i]
            left = b" ".join(words if not mine.any() else [w for w, g in zip(words, mine.tolist()) if not g])
            edges = np.flatnonzero(np.diff(np.r_[0, mine.astype(np.int8), 0]))
            spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
            rows.append((doc_id, len(words), int(mine.sum()), hashlib.sha256(left).hexdigest(), spans, left.decode()))
        return _table(rows, _RESULT)


_WINDOWS = [("bucket", pa.int32()), ("group", pa.int64()), ("values", pa.binary()), ("keys", pa.binary())]
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("repeats", pa.list_(_SPAN)), ("kept", pa.string())]


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, repeats (word spans) and kept (the text that is left)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-size // BYTES_PER_GROUP), min(4 * tasks, size // 65_536))
    find = Finder(window, int(max(1, -(-size // (6 * WORDS_PER_BUCKET)), min(tasks, size // 65_536))))
    group = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(groups)).cast("bigint").alias("group")
    placed = docs.select(group, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def anchors(table: pa.Table) -> pa.Table:
        return find.send_anchors(table)

    def matched_anchors(table: pa.Table) -> pa.Table:
        return find.match_anchors(table)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        return find.send_windows(left, right)

    def matched_windows(table: pa.Table) -> pa.Table:
        return find.match_windows(table)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = find.finish(left, right)
        return out if with_text else out.drop_columns(["repeats", "kept"])

    sent = placed.groupBy("group").applyInArrow(anchors, "bucket int, group bigint, values binary, blocks binary, shared binary")
    hits = sent.groupBy("bucket").applyInArrow(matched_anchors, "group bigint, bucket int, values binary")
    near = placed.groupBy("group").cogroup(hits.groupBy("group")).applyInArrow(windows, "bucket int, group bigint, values binary, keys binary")
    lost = near.groupBy("bucket").applyInArrow(matched_windows, "group bigint, values binary")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    if with_text:
        schema += ", repeats array<struct<first bigint, last bigint>>, kept string"
    return placed.groupBy("group").cogroup(lost.groupBy("group")).applyInArrow(finish, schema)
