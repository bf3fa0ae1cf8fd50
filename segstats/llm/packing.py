"""Best-fit packing of token pieces into sequences by vector best-fit.

A piece asks for three capacities of a sequence: its tokens, one document, and
its attention cost (the square of its length).  All three follow from the
length, so a corpus is a histogram of at most ``max_tokens`` lengths, however
large it is.  Vector best-fit runs over that histogram, longest first: of the
sequences that can hold the piece under every constraint it takes the one with
the least weighted residual norm (or the largest weighted dot product of demand
and residual), for all equal sequences and equal pieces at once.  The plan says
where the i-th piece of a length goes; pieces are numbered within their length
by a count per (length, salt), so a length that holds a third of all pieces is
numbered in as many tasks as it needs.

Defined results: null text is empty (only the end id); only documents longer
than ``max_tokens`` are cut, into full pieces after a first that holds the rest;
pieces of one length are interchangeable; an empty table gives no pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import before
from segstats.llm.tokens import encoder
from segstats.scale import settle

END_ID = 2
MAX_TOKENS = 1024
PIECES_PER_SALT = 20_000
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece of a document."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                total = len(ids) // 4
                cut, piece = (total - 1) % max_tokens + 1, 0  # the first piece holds what full pieces leave
                begin = 0
                while begin < total:
                    for col, v in zip(cols, (doc_id, piece, begin, cut - begin, zlib.crc32(ids[4 * begin : 4 * cut]))):
                        col.append(v)
                    begin, cut, piece = cut, cut + max_tokens, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


class Capacities:
    """What one sequence can hold; ``weights`` scale tokens, documents and attention in the choice."""

    def __init__(self, tokens: int = MAX_TOKENS, documents: int | None = None, attention: int | None = None,
                 weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm"):
        self.limits = np.array([tokens, documents or tokens, attention or tokens * tokens], np.int64)
        self.weights, self.rule = np.array(weights), rule

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)

    def scores(self, residuals: np.ndarray, demand: np.ndarray) -> np.ndarray:
        """Smaller is better."""
        scaled = residuals / self.limits
        if self.rule == "dot":
            return -(scaled * (demand / self.limits) * self.weights).sum(axis=1)
        return (((scaled - demand / self.limits) ** 2) * self.weights).sum(axis=1)


def plan(histogram: dict[int, int], capacities: Capacities) -> dict[int, np.ndarray]:
    """Vector best-fit over counts of lengths.

    Per length an array of rows (first rank, first sequence, pieces in each
    sequence, offset of the first of them), sorted by rank.  A step uses up a
    length or a group of equal sequences, so rows stay a small multiple of the
    number of lengths.
    """
    groups: list[list] = []  # residual, sequences, contents [(length, pieces)]
    residuals = np.zeros((0, 3), np.int64)
    for length in sorted(histogram, reverse=True):
        left, demand = histogram[length], capacities.demand(length)
        if (demand > capacities.limits).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((residuals >= demand).all(axis=1))
            if len(fits):
                at = int(fits[np.argmin(capacities.scores(residuals[fits], demand))])
                residual, count, contents = groups[at]
                used = min(left, count)
                filled = [residual - demand, used, [*contents, (length, 1)]]
                if used == count:
                    groups[at], residuals[at] = filled, filled[0]
                else:
                    groups[at][1] = count - used
                    groups.append(filled)
                    residuals = np.vstack([residuals, filled[0]])
                left -= used
                continue
            most = int((capacities.limits // demand).min())
            for each, count in ((most, left // most), (left % most, 1)):
                if each and count:
                    groups.append([capacities.limits - demand * each, count, [(length, each)]])
                    residuals = np.vstack([residuals, groups[-1][0]])
            left = 0
    out: dict[int, list] = {length: [] for length in histogram}
    rank, sequence = dict.fromkeys(histogram, 0), 0
    for _, count, contents in groups:
        offset = 0
        for length, each in contents:
            out[length].append((rank[length], sequence, each, offset))
            rank[length] += each * count
            offset += each * length
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def numbered(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with _rank: their number within their length, from 0."""
    salts = F.array(*[F.lit(-(-histogram.get(length, 1) // PIECES_PER_SALT)) for length in range(max(histogram) + 1)])
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(salts, F.col("length").cast("int"))))
    offsets = before(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), ["length"], "_salt", "_n", "_before")
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_inside", inside).join(offsets.select("length", "_salt", "_before"), ["length", "_salt"])
    return ranked.select(*pieces.columns, (F.col("_inside") + F.col("_before")).alias("_rank"))


def pack(pieces: DataFrame, capacities: Capacities) -> DataFrame:
    """``pieces`` (with length, doc_id, piece, ids_crc32) with sequence_id and offset."""
    pieces = settle(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length up to max_tokens
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    where, names = plan(histogram, capacities), pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                rows = where[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1]
                step = ranks[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + step // row[:, 2]
                offset[mine] = row[:, 3] + step % row[:, 2] * length
            kept = [batch.column(c) for c in names]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"
    return numbered(pieces, histogram).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacities: Capacities | None = None, end_id: int = END_ID) -> DataFrame:
    capacities = capacities or Capacities()
    return pack(token_pieces(docs, tokenizer, end_id, int(capacities.limits[0])), capacities)
