"""Token-id files with a minimal perfect hash index, for constant-time access by document key.

A corpus is a folder of shards; a shard holds a contiguous range of documents in
ascending doc_id order:

    header   32 bytes: magic, bytes per id, levels, seed, documents, ids
    levels   sizes (u32 each), then a bit array for each, padded to 64 bits
    ranks    u32 for each 64-bit word of the bit arrays: bits set before it
    slots    fingerprint u32, length u32, place u64 (first id), one of each per document
    keys     rows in document order: slot u32
    payload  raw ids, little-endian unsigned, 2 or 4 bytes each

The index is a cascade of bit arrays: a key owns the first level where no other
key has its bit, and its slot is the number of bits set before that bit, so the
slots are exactly 0 .. n-1.  A stored fingerprint tells unknown keys apart.

Shards are cut by ids, so no task holds more than one shard and one batch; their
names depend on the place only, files appear by rename, and a task that runs
again writes the same bytes.  Any file system that pyarrow and Spark both open
can hold the folder.

Defined results: null text is empty (only the end id); rows of equal doc_id are
told apart by their number in order of text; null doc_id comes first; an empty
table gives no shards.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm.common import before
from segstats.llm.tokens import encoder
from segstats.scale import ensure_checkpoint_dir, row_numbers, running, settle, with_chunks

MAGIC = b"TOKSHRD1"
_HEAD = struct.Struct("<8sHHIQQ")
END_ID = 2
IDS_PER_SHARD = 4_000_000
_GAMMA = 1.5


# ---------------------------------------------------------------- minimal perfect hash


def key_hash(doc_id: int | None, number: int = 0, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<?qI", doc_id is None, doc_id or 0, number), seed)


def _spot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each hash in the bit array of a level."""
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and the bits of all levels for distinct 64-bit hashes."""
    sizes, bits, left = [], [], hashes
    while len(left):
        size = max(64, -(-int(_GAMMA * len(left)) // 64) * 64)
        spots = _spot(left, len(sizes), size)
        alone = np.bincount(spots, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[spots]]
    return np.array(sizes, np.uint32), np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(hashes: np.ndarray, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slot of each hash, -1 if no level has its bit."""
    out, open_, start = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
    for level, size in enumerate(sizes):
        spot = _spot(hashes[open_], level, int(size)) + start
        word, bit = words[spot >> 6], (spot & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        out[open_[hit]] = (ranks[spot >> 6] + below)[hit]
        open_, start = open_[~hit], start + int(size)
    return out


# ---------------------------------------------------------------- one shard


def pack_shard(keys: list[tuple[int | None, int]], payloads: list[bytes], vocabulary: int) -> bytes:
    """File of documents (doc_id, number) with their ids as unsigned 32-bit bytes."""
    n, seed = len(keys), 0
    while True:
        hashes = np.array([key_hash(d, k, seed) for d, k in keys], np.uint64)
        if len(np.unique(hashes)) == n:
            break
        seed += 1
    sizes, bits = build_index(hashes)
    words = np.packbits(bits, bitorder="little").view("<u8") if len(bits) else np.zeros(0, "<u8")
    ranks = np.cumsum(np.bitwise_count(words), dtype=np.uint32) - np.bitwise_count(words)
    slots = slots_of(hashes, sizes, words, ranks)
    lengths = np.array([len(p) // 4 for p in payloads], np.int64)
    marks, many, place = np.zeros(n, "<u4"), np.zeros(n, "<u4"), np.zeros(n, "<u8")
    marks[slots], many[slots], place[slots] = hashes >> np.uint64(32), lengths, np.cumsum(lengths) - lengths
    width = 2 if vocabulary <= 1 << 16 else 4
    ids = np.frombuffer(b"".join(payloads), "<u4").astype(f"<u{width}")
    head = _HEAD.pack(MAGIC, width, len(sizes), seed, n, len(ids))
    return b"".join([head, sizes.astype("<u4").tobytes(), words.tobytes(), ranks.astype("<u4").tobytes(), marks.tobytes(), many.tobytes(), place.tobytes(),
                     slots.astype("<u4").tobytes(), np.array([d or 0 for d, _ in keys], "<i8").tobytes(), np.array([d is None for d, _ in keys], bool).tobytes(), ids.tobytes()])


class Shard:
    """A shard read from its bytes."""

    def __init__(self, data: bytes):
        magic, width, levels, self.seed, self.n, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.sizes = take("<u4", levels)
        n_words = int(self.sizes.sum()) // 64
        self.words, self.ranks = take("<u8", n_words), take("<u4", n_words)
        self.marks, self.lengths, self.places = take("<u4", self.n), take("<u4", self.n), take("<u8", self.n)
        self.slots, self.doc_ids, self.nulls = take("<u4", self.n), take("<i8", self.n), take("?", self.n)
        self.ids = take(f"<u{width}", self.n_ids)

    def find(self, keys: list[tuple[int | None, int]]) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each (doc_id, number) through the index, constant work for each; -1 and 0 if the shard does not hold it."""
        h = np.array([key_hash(d, k, self.seed) for d, k in keys], np.uint64)
        slots = slots_of(h, self.sizes, self.words, self.ranks)
        there = slots >= 0
        there[there] = self.marks[slots[there]] == h[there] >> np.uint64(32)
        begin, length = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        begin[there], length[there] = self.places[slots[there]], self.lengths[slots[there]]
        return begin, length

    def get(self, doc_id: int | None, number: int = 0) -> np.ndarray | None:
        """Ids of a document; None if the shard does not hold it."""
        begin, length = (int(x[0]) for x in self.find([(doc_id, number)]))
        return None if begin < 0 else self.ids[begin : begin + length].astype("<u4")

    def all_of(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that doc_id; a match of the stored fingerprint is checked against the stored doc_id."""
        if not hasattr(self, "_begins"):
            self._begins = self.places[self.slots]  # ascending: documents lie in their order and none is empty
        found: list[np.ndarray] = []
        while True:
            begin, length = (int(x[0]) for x in self.find([(doc_id, len(found))]))
            at = int(np.searchsorted(self._begins, begin)) if begin >= 0 else self.n
            if at >= self.n or bool(self.nulls[at]) != (doc_id is None) or int(self.doc_ids[at]) != (doc_id or 0):
                return found
            found.append(self.ids[begin : begin + length])

    def numbered_keys(self) -> Iterator[tuple[int | None, int]]:
        """(doc_id, number) of every document, in order."""
        last, number = object(), 0
        for doc_id, null in zip(self.doc_ids.tolist(), self.nulls.tolist()):
            doc_id = None if null else doc_id
            number = number + 1 if doc_id == last else 0
            last = doc_id
            yield doc_id, number


# ---------------------------------------------------------------- writing and reading

_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def new_folder(spark: SparkSession) -> str:
    """A folder that all executors see, below the one the cluster names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, ids_per_shard: int = IDS_PER_SHARD) -> DataFrame:
    """Encode ``docs`` in ascending doc_id order into ``folder``; one row per shard: part, number, n_docs, n_ids, first_id, last_id."""
    store, path = _opened(folder)
    store.create_dir(path, recursive=True)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, out_fs = TaskContext.get(), encoder(tokenizer), _opened(folder)[0]
        vocabulary = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        keys, payloads, held, number, last, again = [], [], 0, 0, object(), 0

        def close() -> pa.RecordBatch:
            nonlocal keys, payloads, held, number
            name = f"{path}/shard-{task.partitionId():06d}-{number:06d}.ids"
            draft = f"{path}/_draft-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}"
            with out_fs.open_output_stream(draft) as f:
                f.write(pack_shard(keys, payloads, vocabulary))
            out_fs.move(draft, name)
            row = pa.record_batch([[task.partitionId()], [number], [len(keys)], [held], [keys[0][0]], [keys[-1][0]]], schema=_MANIFEST)
            keys, payloads, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                if keys and held + len(ids) // 4 > ids_per_shard:
                    yield close()
                    last = object()  # repeated ids are numbered anew in each shard
                again = again + 1 if doc_id == last else 0
                last = doc_id
                keys.append((doc_id, again))
                payloads.append(ids)
                held += len(ids) // 4
        if keys:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return settle(ordered.mapInArrow(run, "part int, number int, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint"))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files through the index: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, number = map(int, re.search(r"shard-(\d+)-(\d+)\.ids$", name).groups())
                shard = Shard(content.as_buffer().to_pybytes())
                keys = list(shard.numbered_keys())
                begin, length = shard.find(keys)
                wide = shard.ids.astype("<u4").tobytes()
                sums = [zlib.crc32(wide[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())]
                yield pa.record_batch([pa.array([part] * shard.n, pa.int32()), pa.array([number] * shard.n, pa.int32()), pa.array([d for d, _ in keys], pa.int64()),
                                       pa.array(np.cumsum(length) - length), pa.array(length), pa.array(sums, pa.int64())],
                                      names=["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ids").load(folder).select("path", "content")
    docs = files.mapInArrow(run, "part int, number int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    parts = before(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")), [], "part", "n", "before_part")
    places = before(manifest, ["part"], "number", "n_ids", "inside").join(parts, "part").select("part", "number", (F.col("before_part") + F.col("inside")).alias("base"))
    return docs.join(places, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def shards_of(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """The shards that may hold each distinct doc_id of ``keys``: doc_id, part, number.

    Shards lie in the order of their ids, so those of a key end at the last shard
    that begins at or before it and start at the last one that begins before it: two
    running maxima over keys and shards in one order.  Null is the smallest id.
    """
    shards = settle(row_numbers(manifest, ["part", "number"], out="ordinal").select("part", "number", "first_id", "last_id", F.col("ordinal").cast("bigint").alias("ordinal")))
    ids = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    none = F.lit(None).cast("bigint")
    events = (ids.select("doc_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"), none.alias("ordinal"))
              .unionByName(shards.select(F.col("first_id").alias("doc_id"), F.lit(1).alias("kind"), "ordinal")))
    events = events.withColumns({"known": F.col("doc_id").isNotNull(), "least": F.coalesce("doc_id", F.lit(0))})
    order = ["known", "least", "kind"]
    seen = running(with_chunks(events, order), [], order, {"upto": ("max", "ordinal")}).where("kind <> 1")
    ends = seen.groupBy("known", "least").agg(F.max(F.when(F.col("kind") == 0, F.col("upto"))).alias("low"), F.max(F.when(F.col("kind") == 2, F.col("upto"))).alias("high"))
    spans = ends.where("high is not null").select(F.when(F.col("known"), F.col("least")).alias("doc_id"), F.explode(F.sequence(F.coalesce("low", F.lit(1)), "high")).alias("ordinal"))
    reaches = F.col("doc_id").isNull() | (F.col("last_id") >= F.col("doc_id"))
    return spans.join(shards, "ordinal").where(reaches).select("doc_id", "part", "number")


def lookup(keys: DataFrame, folder: str, manifest: DataFrame) -> DataFrame:
    """The documents of each distinct doc_id of ``keys``: doc_id, part, number, copy, ids; ids that no shard holds give no row.

    Only shards whose range holds a key are opened, each once by a task; the keys of
    one shard may be read by several tasks.  ``copy`` counts the documents of a
    doc_id inside a shard.
    """
    path = _opened(folder)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, name, shard = _opened(folder)[0], None, None
        for batch in batches:
            for doc_id, part, number in zip(*(c.to_pylist() for c in batch.columns)):
                if name != (name := f"{path}/shard-{part:06d}-{number:06d}.ids"):
                    with out_fs.open_input_file(name) as f:
                        shard = Shard(f.read())
                for copy, ids in enumerate(shard.all_of(doc_id)):
                    yield pa.record_batch([pa.array([doc_id], pa.int64()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([copy], pa.int64()),
                                           pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "part", "number", "copy", "ids"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = shards_of(keys, manifest).repartitionByRange(n, "part", "number", "doc_id").sortWithinPartitions("part", "number", "doc_id")
    return asked.mapInArrow(run, "doc_id bigint, part int, number int, copy bigint, ids array<bigint>")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write ``docs`` and read them back."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    manifest = write_shards(docs, folder, tokenizer, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_shards(spark, folder, manifest)
