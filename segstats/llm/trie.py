"""Prefix trie of conversations by whole-sequence collapse.

Conversations are rebuilt around shared openings (:func:`rebuilt`), and every
prefix gets a 128-bit name: the running xor of two hashes of (place, turn), a
prefix scan, so no conversation is gathered in one row.  Identical conversations
collapse into one weighted sequence with the list of those that end there.
Sequences that are proper prefixes of others are found by anti-join; what is
left are the leaves of the trie.  The prefixes of the distinct sequences,
weighted, add up to the nodes.  Sums over subtrees take no walk over the trie:
each node is owned by the smallest leaf sequence below it, sums from the deep
end run along every leaf sequence, and the sum of a subtree is the sum of these
at its top.

The list of a sequence is hashed as a stream: the ids of a range of 4,096 are
joined where they are, and the ranges pass one after the other.

Defined results: turns are ordered by turn (null first), equal ones by the
SHA-256 of role and text; null role and text are empty; remainders have the sign
of the conv_id, as in SQL; turns of null conv_id
are one conversation without a shared opening, whose id is larger than any and
not listed (the largest bigint stands for it inside); a conversation that has
no turns when rebuilt is a member of the root; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import WORD
from segstats.scale import forget, row_numbers, running, settle, with_chunks

GROUP, MOST = 20, 4
NULL = (1 << 63) - 1
RANGE = 4096
KEY = ["depth", "a", "b"]


def opening(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group: crc32 of its decimal id, mod ``MOST``."""
    return F.when(conv == NULL, F.lit(0)).otherwise(F.crc32(conv.cast("string").cast("binary")) % MOST)


def turns(conversations: DataFrame) -> DataFrame:
    """Settled: c (the conversation), place from 1, content (SHA-256 of role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NULL)).alias("c"), F.col("turn").cast("bigint").alias("turn"),
                                F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("content"),
                                F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    return settle(row_numbers(rows, ["turn", "content"], ["c"], "place").select("c", F.col("place").cast("bigint").alias("place"), "content", "words"))


def rebuilt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c) of all conversations, and their turns after rebuilding: the first of their group's first conversation, then their own after as many."""
    convs = found.select("c").distinct().withColumns({"first": F.col("c") - F.col("c") % GROUP, "h": opening(F.col("c"))})
    convs = settle(convs.withColumn("first", F.when(F.col("c") != NULL, F.col("first"))))
    heads = found.where((F.col("place") < MOST) & (F.col("c") % GROUP == 0)).withColumnRenamed("c", "first")  # MOST - 1 turns of each at most
    shared = convs.where("h > 0").join(heads, "first").where(F.col("place") <= F.col("h")).select("c", "place", "content", "words")
    taken = convs.where("h > 0").join(heads.groupBy("first").agg(F.count(F.lit(1)).alias("n")), "first").select("c", F.least("n", "h").alias("k"))
    own = found.where(F.col("place") > opening(F.col("c"))).join(taken, "c", "left")
    moved = F.col("place") - opening(F.col("c")) + F.coalesce("k", F.lit(0))
    return convs.select("c"), shared.unionByName(own.select("c", moved.alias("place"), "content", "words"))


def named(sequence: DataFrame) -> DataFrame:
    """Settled: c, depth, the name (a, b) of the prefix that ends there and (pa, pb) of the one before, words of the turn."""
    marks = sequence.select("c", F.col("place").cast("bigint").alias("depth"), F.xxhash64("place", "content").alias("ha"), F.xxhash64("content", "place", F.lit(1)).alias("hb"), "words")
    cut = with_chunks(marks, ["depth"], by=["c"])
    names = running(cut, ["c"], ["depth"], {"a": ("xor", "ha"), "b": ("xor", "hb")})
    return settle(names.select("c", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "words"))


def list_hashes(ends: DataFrame) -> DataFrame:
    """For each sequence (KEY) the SHA-256 of the ids that end there, ascending, joined by commas; any number of them, as a stream."""
    some = ends.where(F.col("c") != NULL).groupBy(*KEY, F.expr(f"c div {RANGE}").alias("at")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))  # 2 * RANGE ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *new, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if new != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = new, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.record_batch([pa.array(x) for x in zip(*done)], names=[*KEY, "ends"])
        if key is not None:
            yield pa.record_batch([pa.array([x]) for x in (*key, state.hexdigest())], names=[*KEY, "ends"])

    return some.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(run, "depth bigint, a bigint, b bigint, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    zero = F.lit(0).cast("bigint")
    found = turns(conversations)
    convs, sequence = rebuilt(found)
    chain = named(sequence)
    last = chain.groupBy("c").agg(F.max(F.struct(*KEY)).alias("last"))
    ends = settle(convs.join(last, "c", "left").select("c", *[F.coalesce(F.col(f"last.{k}"), zero).alias(k) for k in KEY]))
    sequences = settle(ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("c").alias("c")))

    prefixes = chain.join(sequences.select("c", "weight"), "c")
    roots = sequences.select("c", *[zero.alias(k) for k in (*KEY, "pa", "pb", "words")], "weight")
    prefixes = prefixes.unionByName(roots)
    inner = prefixes.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).where("depth >= 0").distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("c", F.lit(True).alias("leaf"))
    prefixes = settle(prefixes.join(leaves, "c", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))))

    nodes = settle(prefixes.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("c").alias("first"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
        F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("c"))).alias("owner")))
    owned = nodes.select(*KEY, "owner", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    lines = prefixes.where("leaf").select("c", *KEY).join(owned, KEY).select(
        "c", *KEY, (-F.col("depth")).alias("up"), F.when(F.col("c") == F.col("owner"), F.col("saved")).otherwise(0).alias("saved"))
    below = running(with_chunks(lines, ["up"], by=["c"]), ["c"], ["up"], {"sum": ("sum", "saved")})

    facts = below.groupBy(*KEY).agg(F.sum("sum").alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = facts.join(children, KEY, "left").join(list_hashes(ends), KEY, "left").join(nodes.drop("words", "owner"), KEY)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("first").alias("parent"))
    named_parent = whole.join(parents, ["depth", "pa", "pb"], "left")
    real = lambda c: F.when(F.col(c) != NULL, F.col(c))
    out = named_parent.select(real("first").alias("conv_id"), "depth", real("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                              "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    forget(found)
    return out
