"""Merkle manifest of a table: one tree per language, one tree over their roots, and a proof for every row.

The leaves of a tree are numbered by a prefix scan and laid out in aligned blocks
of ``FANOUT`` ** 3 neighbours, so a block holds whole subtrees and is the
partition of the method.  The upper levels are found by butterfly exchange
(:func:`climb`): in round r every block swaps the ancestor it knows with one
partner in each sibling group of ``FANOUT`` ** r blocks, and hashes the next
ancestor itself, as all members of its group do.  After the last round every
block holds the root and the siblings of all its ancestors; nothing is sent
down.  Where the last sibling group is not full, its members serve several
partners; that join is split at run time.  The roots of the languages climb
by the same function.

H is the lowercase hexadecimal SHA-256; inputs are concatenated, digests as text.
A run of fewer than ``FANOUT`` nodes at the end of a level, even of one, is
hashed like any other while the level has several nodes.

Defined results: a null field is ``-``; rows of null language are a tree of
their own, the first; rows that repeat a doc_id stand by the digest of their
leaf, null doc_id first; a lone leaf is its own root; an empty table gives no
rows; extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import LOWER, UPPER
from segstats.scale import forget, row_numbers, settle

FANOUT, HEIGHT = 8, 3
BLOCK = FANOUT**HEIGHT
PATH = "array<struct<place:int,siblings:string>>"


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """H of doc_id, source, lang, n_chars and ``text``."""
    return h(field(F.col("doc_id").cast("bigint").cast("string")), field(F.col("source").cast("string")), field(F.col("lang").cast("string")),
             field(F.col("n_chars").cast("bigint").cast("string")), field(text))


def tampered(text: Column) -> tuple[Column, Column]:
    """Rows whose crc32 of the doc_id is divisible by 3, and what becomes of their text: A-Z in lower case."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 3 == 0, F.lit(False)), F.translate(text, UPPER, LOWER)


def _runs(level: Column) -> Column:
    """The next level of a block: H of every run."""
    starts = F.sequence(F.lit(0), F.size(level) - 1, F.lit(FANOUT))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(level, i + 1, F.lit(FANOUT)), ""), 256))


def blocks(docs: DataFrame) -> DataFrame:
    """One settled row per block: lang, block, its rows in order (doc_ids, l0 = leaves, changed) and the levels l1, l2, its root and height.

    ``changed`` is the leaf of the tampered row, null where nothing was done to it.
    """
    text = F.col("text").cast("string")
    hit, other = tampered(text)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(text).alias("leaf"),
                       F.when(hit, leaf(other)).alias("changed"))
    placed = row_numbers(rows, ["doc_id", "leaf"], ["lang"], "_n").withColumn("block", F.floor((F.col("_n") - 1) / BLOCK).cast("bigint"))
    members = F.sort_array(F.collect_list(F.struct("_n", "doc_id", "leaf", "changed")))  # BLOCK of them at most
    packed = placed.groupBy("lang", "block").agg(members.alias("m"))
    flat = settle(packed.select("lang", "block", F.col("m.doc_id").alias("doc_ids"), F.col("m.leaf").alias("l0"), F.col("m.changed").alias("changed")))
    n = F.size("l0")
    alone = (F.col("block") == 0) & (n < BLOCK)  # a whole tree: it ends when one node is left
    height = reduce(lambda rest, k: F.when(n <= FANOUT**k, F.lit(k)).otherwise(rest), reversed(range(HEIGHT)), F.lit(HEIGHT))
    found = flat.withColumn("l1", _runs(F.col("l0"))).withColumn("l2", _runs(F.col("l1"))).withColumn("height", F.when(alone, height).otherwise(F.lit(HEIGHT)))
    root = F.when(F.col("height") == 3, F.sha2(F.array_join("l2", ""), 256)).otherwise(F.get(F.get(F.array("l0", "l1", "l2"), F.col("height")), F.lit(0)))
    out = settle(found.withColumn("block_root", root))
    forget(flat)
    return out


def climb(nodes: DataFrame) -> DataFrame:
    """Butterfly exchange over ``nodes`` (tree, i from 0, n of the tree, digest): tree, i, root and the path from the node to it.

    A round takes a node whose ancestors up to level r are known to every node
    below them.  Node i asks, for each other member j of the run of its ancestor,
    the node at its own place under j (modulo the number of nodes there).
    """
    state = settle(nodes.select("tree", "i", "n", "digest", F.lit(None).cast(PATH).alias("path")).withColumn("path", F.coalesce("path", F.array().cast(PATH))))
    largest = state.agg(F.max("n")).first()[0] or 0
    size = 1
    while size < largest:
        own = F.floor(F.col("i") / size).cast("bigint")
        level = F.ceil(F.col("n") / size).cast("bigint")
        run = own - own % FANOUT
        others = F.array_except(F.sequence(run, F.least(run + FANOUT, level) - 1), F.array(own))
        asked = state.where(level > 1).select("tree", "i", F.col("n"), F.explode(others).alias("j"))
        below = F.least(F.lit(size), F.col("n") - F.col("j") * size)
        asked = asked.select("tree", "i", "j", (F.col("j") * size + F.col("i") % size % below).cast("bigint").alias("partner"))
        heard = asked.join(state.select("tree", F.col("i").alias("partner"), F.col("digest").alias("said")), ["tree", "partner"])
        mine = state.select("tree", "i", own.alias("j"), F.col("digest").alias("said"), "n", "path")
        said = mine.unionByName(heard.select("tree", "i", "j", "said"), allowMissingColumns=True)
        met = said.groupBy("tree", "i").agg(F.max("n").alias("n"), F.max("path").alias("path"), F.sort_array(F.collect_list(F.struct("j", "said"))).alias("run"))
        of = F.floor(F.col("i") / size).cast("bigint")
        siblings = F.array_join(F.filter("run", lambda m: m["j"] != of).getField("said"), "")
        step = F.struct((of % FANOUT).cast("int").alias("place"), siblings.alias("siblings"))
        going = F.ceil(F.col("n") / size) > 1
        digest = F.when(going, F.sha2(F.array_join(F.col("run.said"), ""), 256)).otherwise(F.get(F.col("run.said"), F.lit(0)))
        after = settle(met.select("tree", "i", "n", digest.alias("digest"), F.when(going, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path")))
        forget(state)
        state, size = after, size * FANOUT
    return state.select("tree", "i", F.col("digest").alias("root"), "path")


def _step(level: Column, at: Column) -> Column:
    """Place of node ``at`` in its run of a block's level, and its siblings there."""
    place = at % FANOUT
    before = F.array_join(F.slice(level, at - place + 1, place), "")
    after = F.array_join(F.slice(level, at + 2, F.lit(FANOUT - 1) - place), "")
    return F.struct(place.cast("int").alias("place"), F.concat(before, after).alias("siblings"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), s["place"] * 64), d, F.substr(s["siblings"], s["place"] * 64 + 1)), 256))


def proofs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, changed, subroot, root and the path of its siblings from leaf to root."""
    packed = blocks(docs)
    heads = packed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    trees = settle(row_numbers(heads, ["lang"], out="_n").select("lang", "n", (F.col("_n") - 1).alias("tree")))
    same = packed["lang"].eqNullSafe(trees["lang"])
    numbered = packed.join(trees, same).select(trees["tree"], packed["block"].alias("i"), trees["n"], packed["block_root"].alias("digest"))
    upper = climb(numbered).withColumnsRenamed({"root": "subroot", "path": "upper"})
    heads = upper.where("i = 0").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("i"), F.lit(trees.count()).cast("bigint").alias("n"), F.col("subroot").alias("digest"))
    top = climb(heads).select(F.col("i").alias("tree"), "root", F.col("path").alias("top"))
    ways = settle(upper.join(top, "tree").join(trees.select("tree", "lang"), "tree").select(
        F.col("lang").alias("_lang"), F.col("i").alias("_block"), "subroot", "root", F.concat("upper", "top").alias("above")))
    placed = packed.join(ways, packed["lang"].eqNullSafe(ways["_lang"]) & (packed["block"] == ways["_block"]))

    def row(first: Column, p: Column) -> Column:
        steps = F.array(_step(F.col("l0"), p), _step(F.col("l1"), F.floor(p / FANOUT).cast("int")), _step(F.col("l2"), F.floor(p / FANOUT**2).cast("int")))
        path = F.concat(F.slice(steps, F.lit(1), F.col("height")), F.col("above"))
        return F.struct(F.get(F.col("doc_ids"), p).alias("doc_id"), first.alias("leaf"), F.get(F.col("changed"), p).alias("changed"), path.alias("path"))

    return placed.select("subroot", "root", F.inline(F.transform("l0", row))).select("doc_id", "leaf", "changed", "subroot", "root", "path")


def verified(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = proofs(docs)
    proof = F.sha2(F.array_join(F.col("path.siblings"), ""), 256)
    folded = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
