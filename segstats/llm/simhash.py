"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Of two fingerprints that differ in at most 3 bits, one 32-bit half differs in at
most 1.  Half the radius, rounded down, is 1: every distinct fingerprint emits
for each half all variants within 1 bit (33 of them), the variants are shuffled,
and meet the fingerprints whose half is exactly that variant.  The colliding
pairs are deduplicated and verified over all 64 bits.  No pair within the radius
is missed, and equal fingerprints meet as one.

:func:`keep_one_of_similar` is the form for a corpus: texts are near copies when
their sets of five-word shingles have a Jaccard similarity of 0.8 or more, which
puts fingerprints many bits apart.  So fingerprints of 256 bits are cut into
eight blocks; each block emits all variants within 1 bit, half of the radius 2,
variants meet variants, and colliding pairs within the radius of the whole
fingerprint are verified by their shingles, unless a sketch of their shingles
proves them unlike.

The groups are the connected components of the links, labelled with their
smallest doc_id.  A hot fingerprint is one node whatever the number of its
documents, and the join that gives the labels back is split at run time.

Defined results: null text is empty; a text without words has fingerprint zero,
which links like any other; fewer words than a shingle make one shingle; rows
that repeat a doc_id are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import LOWER, UPPER, drop_shuffles, fresh, parts, text_of
from segstats.llm.components import connected
from segstats.operators.matching import connected_groups
from segstats.scale import forget, measured_broadcasts, settle

SEED = 42
BITS = 3
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLOCK = 65_536


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash over shingles of ``words`` words, repeats included: a bit is set if over half the hashes have it."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):  # a very long text takes no more memory than this at once
        rows = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, words: int = 3, out: str = "fp") -> DataFrame:
    """doc_id, a hash of the whole text (``mark``) and the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "mark", out])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(text_of()).alias("mark"))
    return rows.mapInArrow(run, f"doc_id bigint, mark bigint, {out} bigint")


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * side).bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column ``fp``) that differ in at most ``bits`` <= 3 bits."""
    if not 0 <= bits <= 3:
        raise ValueError("a half differs in at most 1 bit up to 3 bits only")
    measured_broadcasts(fps.sparkSession)  # the estimate of the variants is that of the fingerprints, 33 times too small
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _half(F.col("fp"), s).alias("half")) for s in (0, 1)])).alias("h")
    halves = fps.select("fp", sides).select("fp", "h.side", "h.half")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << j).cast("bigint") for j in range(32)])
    balls = halves.select(F.col("fp").alias("b"), "side", F.explode(F.transform(flips, lambda f: F.col("half").bitwiseXOR(f))).alias("half"))
    near = halves.withColumnRenamed("fp", "a").join(balls, ["side", "half"]).where(F.col("a") < F.col("b"))
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b").distinct()


def components(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` (doc_id, fp) with component_id: the smallest doc_id that links lead to, and _group, a number of its own for each component."""
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = settle(links(nodes.select("fp"), bits))
    linked = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    groups = connected_groups(pairs.withColumnRenamed("a", "fp"), linked, [], "fp", "b")
    placed = settle(nodes.join(groups, "fp", "left").select("fp", "least", F.coalesce("group_id", "fp").alias("_group")))
    least = placed.groupBy("_group").agg(F.min("least").alias("component_id"))
    return rows.join(settle(placed.select("fp", "_group").join(least, "_group")), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = components(settle(with_fingerprints(docs, words)), bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 3, bits: int = BITS) -> DataFrame:
    """Of each group the row with the smallest doc_id, once, with all columns of ``docs``; null doc_id only where a group has no other."""
    ident, mark, many, null = fresh(docs, "_ident", "_mark", "_many", "_null")
    found = components(settle(with_fingerprints(docs, words)), bits)
    ends = found.groupBy("_group", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).groupBy("_group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark", "n")).alias("r"))
    stays = ends.select(F.col("r.null").alias(null), F.coalesce("r.doc_id", F.lit(0)).alias(ident), F.col("r.mark").alias(mark), (F.col("r.n") > 1).alias(many))
    keyed = docs.withColumns({null: F.col("doc_id").isNull(), ident: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), mark: F.xxhash64(text_of())})
    kept = keyed.join(settle(stays), [null, ident, mark])
    once = kept.where(~F.col(many)).unionByName(kept.where(F.col(many)).dropDuplicates([null, ident, mark]))
    return once.select(*docs.columns)


# ---------------------------------------------------------------- near copies by shingle similarity

#: Words of a shingle and similarity of near copies; words of the shingles that are hashed into fingerprints, their 64-bit lanes, bits of a block, and
#: the radius of a whole fingerprint (near copies of 0.8 lie 39 bits apart at the mean where edits are one block, others fewer; strangers 100 and more).
SHINGLE, SIMILAR = 5, 0.8
FEATURE, LANES, BLOCK_BITS, RADIUS = 2, 4, 32, 56
#: Words of 64 bits in a parity sketch: texts of up to some thousand shingles.
PARITIES = 8
NODES_PER_TASK = 4096
#: Blocks whose variants are shuffled at once; leads that members of a variant meet before they meet each other.
BLOCKS_AT_ONCE, FURTHER_LEADS = 2, 2


def _shingles(found: list[bytes], words: int) -> list[bytes]:
    if not found:
        return []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words))))) if len(found) >= words else [b" ".join(found)]


def long_fingerprint(text: bytes, words: int = FEATURE, lanes: int = LANES) -> list[int]:
    """``lanes`` SimHashes of 64 bits with hashes of their own, as signed numbers."""
    shingles = _shingles(text.translate(_LOWER).split(), words)
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), _BLOCK):
            part = shingles[at : at + _BLOCK]
            rows = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED + lane)), np.uint64, len(part)).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0]))
    return out


def _shingle_hashes(text: bytes) -> np.ndarray:
    """The distinct hashes of the five-word shingles, sorted."""
    shingles = _shingles(text.translate(_LOWER).split(), SHINGLE)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """``PARITIES`` x 64 bits, each the parity of the hashes that fall on it, as signed numbers; then the number of hashes.

    Two sets differ in at least as many elements as their sketches in bits, so a
    sketch never turns a similar pair away.
    """
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return [*np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist(), len(hashes)]


def _long_prints(rows: DataFrame) -> DataFrame:
    """fp: the long fingerprint, followed by the parity sketch of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(3))
            prints = [long_fingerprint(t) + parity_sketch(_shingle_hashes(t)) for t in texts]
            yield pa.record_batch([*batch.columns[:3], pa.array(prints, pa.list_(pa.int64())), batch.column(4)], names=["row", "doc_id", "digest", "fp", "place"])

    return rows.mapInArrow(run, "row bigint, doc_id bigint, digest string, fp array<bigint>, place bigint")


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """``rows`` (node, text) -> node, shingles: the distinct hashes of the five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"").view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.record_batch([batch.column(0), lists.cast(pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles array<bigint>")


def _differing(a: str, b: str, lanes: range) -> Column:
    found = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in lanes]
    return sum(found[1:], found[0])


def _candidates(a: str, b: str) -> Column:
    """Fingerprints within the radius, and nothing in the numbers and parities of the shingles that rules a similarity of ``SIMILAR`` out."""
    few, many = F.least(*(n := [F.get(c, F.lit(LANES + PARITIES)) for c in (a, b)])), F.greatest(*n)
    most = (few + many) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6
    return (_differing(a, b, range(LANES)) <= RADIUS) & (few >= SIMILAR * many - 1e-6) & (_differing(a, b, range(LANES, LANES + PARITIES)) <= most)


def _block(fp: str, no: Column) -> Column:
    """Block ``no`` of a long fingerprint."""
    per = 64 // BLOCK_BITS
    shift = (F.lit(BLOCK_BITS) * (no % per)).cast("int")
    return F.call_function("shiftrightunsigned", F.get(fp, (no / per).cast("int")), shift).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _meet_here(a: str, b: str) -> Column:
    """Of the variants that two blocks share, ``key`` is the one where the pair is taken: once a block, not once a variant."""
    no = F.shiftright("key", BLOCK_BITS)
    one, two = _block(a, no), _block(b, no)
    differ = one.bitwiseXOR(two)
    lowest = differ.bitwiseAND(-differ)
    return F.col("key").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == F.least(one.bitwiseXOR(lowest), two.bitwiseXOR(lowest))


def _collisions(nodes: DataFrame) -> list[DataFrame]:
    """node, key and the smallest node of every variant that several nodes emit; a task makes the variants of some ``NODES_PER_TASK`` nodes.

    Settled tables, one for each ``BLOCKS_AT_ONCE`` blocks: variants of other blocks
    never meet, so only so many of them are on the disks at a time.
    """
    nodes = settle(nodes.repartition(parts(nodes.count(), NODES_PER_TASK, nodes.sparkSession)))
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << j).cast("bigint") for j in range(BLOCK_BITS)])
    same = Window.partitionBy("key")
    out = []
    for first in range(0, LANES * 64 // BLOCK_BITS, BLOCKS_AT_ONCE):
        blocks = [F.struct(F.lit(k).cast("bigint").alias("no"), _block("fp", F.lit(k)).alias("bits")) for k in range(first, first + BLOCKS_AT_ONCE)]
        cut = nodes.select("node", F.inline(F.array(*blocks)))
        balls = cut.select("node", F.explode(F.transform(flips, lambda f: F.shiftleft("no", BLOCK_BITS).bitwiseOR(F.col("bits").bitwiseXOR(f)))).alias("key"))
        met = balls.select("node", "key", F.min("node").over(same).alias("lead"), F.max("node").over(same).alias("_last"))
        out.append(settle(met.where(F.col("lead") != F.col("_last")).drop("_last")))
    forget(nodes)
    return out


def _listed(met: DataFrame, fps: DataFrame) -> DataFrame:
    """node, keys, fp: the variants where :func:`_meet_here` takes the node with any other, 33 a block at most, in one row.

    Equal blocks are taken at themselves.  Of others the larger flip decides: the
    variant is the smaller place of the two if that flip leads to a larger block.
    """
    listed = lambda rows: rows.groupBy("node").agg(F.collect_list("key").alias("keys")).join(fps, "node")
    at = F.col("key").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    flips = listed(met).select("node", "fp", F.explode("keys").alias("key"))
    flips = flips.select("node", "key", at.bitwiseXOR(_block("fp", F.shiftright("key", BLOCK_BITS))).alias("flip"))
    same = Window.partitionBy("key")
    up = F.max(at.bitwiseXOR(F.col("flip"))).over(same).bitwiseXOR(at)  # the flip of the largest block
    unequal = (at.bitwiseXOR(up) > at) & (F.col("flip") <= up) & (F.min("flip").over(same) < up)
    equal = (F.col("flip") == 0) & (F.sum(F.when(F.col("flip") == 0, 1).otherwise(0)).over(same) > 1)
    return settle(listed(flips.select("node", "key", (unequal | equal).alias("_taken")).where("_taken")))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar; the texts stay in the buckets of their place, where the nodes of ``pairs`` meet them."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("node", "place"), "node").select("place").distinct()
    sets = settle(_shingle_sets(texts.join(wanted.hint("shuffle_hash"), "place", "left_semi").select("node", "text")))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    every = F.size("sa") + F.size("sb") - shared
    near = pairs.join(left, "a").join(right, "b").where((every == 0) | (shared >= SIMILAR * every)).select("a", "b")
    out = settle(near)
    forget(sets)
    return out


def similar_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (row, place, doc_id, text), settled in buckets of their place -> row, place, doc_id, group: equal for rows that links of near copies join.

    No colliding pair of different components is left untested, and no table of all
    pairs of a group is made: first every node meets the smallest node of each
    variant; then, ``FURTHER_LEADS`` times, the members of a variant that are not in
    one component yet meet another lead of it, drawn by a hash; those still apart
    meet each other.  A node carries the list of its variants, so labels are joined
    once a node and not once a variant.
    """
    text = F.translate(text_of(), UPPER, LOWER)
    prints = settle(_long_prints(rows.select("row", "doc_id", F.sha2(text, 256).alias("digest"), F.col("text").cast("string").alias("text"), "place")))
    first = F.min(F.struct("row", "place")).alias("r")
    nodes = settle(prints.groupBy("digest").agg(first, F.max("fp").alias("fp")).select("digest", F.col("r.row").alias("node"), "r.place", "fp"))
    fps = nodes.select("node", "fp")
    tables = _collisions(fps)
    met = reduce(DataFrame.unionByName, tables)
    texts = rows.withColumnRenamed("row", "node")
    sides = [fps.select(F.col("node").alias(c), F.col("fp").alias("f" + c)) for c in "ab"]

    stars = met.where(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(sides[0], "a").join(sides[1], "b")
    labels = settle(connected(_verified(settle(stars.where(_candidates("fa", "fb")).select("a", "b")), nodes, texts)))

    listed = _listed(met, fps)
    least, greatest = F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")
    for turn in range(FURTHER_LEADS + 1):
        labelled = listed.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "fp", F.explode("keys").alias("key"))
        if turn == FURTHER_LEADS:
            same = Window.partitionBy("key")
            labelled = labelled.withColumns({"low": F.min("label").over(same), "high": F.max("label").over(same)}).where("low <> high").drop("low", "high")
        members = settle(labelled)
        one, two = (members.select("key", *[F.col(c).alias(c + side) for c in ("node", "label", "fp")]) for side in "ab")
        if turn < FURTHER_LEADS:
            order = F.struct(F.xxhash64(F.col("node"), F.lit(turn)).alias("h"), F.col("node").alias("nodea"), F.col("label").alias("labela"), F.col("fp").alias("fpa"))
            leads = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(order).alias("r")).where("low <> high")
            one = leads.select("key", "r.nodea", "r.labela", "r.fpa")
        apart = (F.col("labela") != F.col("labelb")) & (F.lit(True) if turn < FURTHER_LEADS else (F.col("nodea") < F.col("nodeb")) & _meet_here("fpa", "fpb"))
        pairs = settle(one.join(two, "key").where(apart & _candidates("fpa", "fpb")).select(least, greatest).distinct())
        forget(members)
        if pairs.isEmpty():
            continue
        stars = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
        labels = settle(connected(stars.unionByName(_verified(pairs, nodes, texts))))

    placed = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("group"))
    out = settle(prints.select("row", "place", "doc_id", "digest").join(placed, "digest").select("row", "place", "doc_id", "group"))
    for done in (prints, listed, nodes, *tables):
        forget(done)
    return out


def keep_one_of_similar(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, with all columns of ``docs``; null doc_id only where a group has no other.

    The texts are shuffled once, into buckets of a hash of doc_id and text; what looks
    at some of them later, and the rows that stay, meet them there.
    """
    place, row, kept = fresh(docs, "_place", "_row", "_kept")
    drop_shuffles(docs.sparkSession)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.withColumn(place, F.xxhash64(F.col("doc_id"), text_of())).repartition(buckets, place)
    held = settle(spread.withColumn(row, F.monotonically_increasing_id()), (buckets, place))  # numbered where they are written
    named = [F.col(row).alias("row"), F.col(place).alias("place"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"]
    groups = similar_groups(held.select(*named))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "place")).alias("r")
    stay = settle(groups.groupBy("group").agg(first).select(F.col("r.place").alias(place), F.col("r.row").alias(kept)))
    forget(groups)
    # Rows that repeat doc_id and text share a place; the row is no join key, which would move the texts again.
    same = (held[place] == stay[place]) & held[row].between(stay[kept], stay[kept])
    return held.join(stay.hint("shuffle_hash"), same, "left_semi").select(*docs.columns)
