"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.scale import forget, settle


def connected(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links`` (a, b) -> node, label: the smallest node of its component; nodes without links are not listed.

    Every round hangs the larger neighbours of each node on its smallest one
    (large star), then a node's smaller neighbours on the smallest of them (small
    star), until every component is one star.  Smallest neighbours are aggregates;
    no task holds the neighbours of a node.  Rounds grow with the logarithm of the
    longest chain and are settled.
    """
    state = settle(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = _mark(state)
    for _ in range(max_rounds):
        both = state.select("v", "u").unionByName(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = settle(both.where(F.col("u") > F.col("v")).join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        met = large.join(least, "v")
        after = settle(met.where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        for old in (state, large):
            forget(old)
        state, before, seen = after, seen, _mark(after)
        if seen == before:
            return state.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(state.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
    raise RuntimeError(f"no components after {max_rounds} rounds")


def _mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v"))).first())
