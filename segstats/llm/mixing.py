"""Mixing of sources to target weights by weighted fair queueing.

Every source is a queue of its documents in hash order, repeated as often as the
limit allows.  A document's virtual finish time is the number of words its
source has sent so far, divided by the target of the source.  All queues are
merged by virtual time and the mix ends when the total budget is sent, which is
at virtual time 1 because the targets add up to the budget.

The running sums are cut into slices of the hash order: sums per (source,
slice) are combined before the shuffle, and a window runs inside a slice only,
so a source with a third of all rows is spread over as many tasks as its size
asks for.

Defined results: null text is empty; size 0 takes nothing; a null source is a
source of its own and the last in order; documents that tie in hash order follow
doc_id and size; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import WORD, before, parts
from segstats.scale import settle

WEIGHTS = (5, 2, 1)
REPEATS = 3
ROWS_PER_SLICE = 20_000


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(column: str = "source") -> Column:
    """Never null, and null apart from every name."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def shuffle_hash(seed: int) -> Column:
    """32 hexadecimal digits that order the documents of a source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (_source, source_size) with target, in words.

    Sources in code-point order, null last, weigh ``weights`` in turn.  A target
    stops at ``repeats`` times the size; what is above is shared again by weight.
    Each pass over the sources gives two sums, the driver holds nothing else.
    """
    spark = sources.sparkSession
    # The place in order: range partitions numbered inside, and the counts of the partitions before.
    ordered = sources.withColumn("_null", F.col("_source") == "-")
    n = parts(sources.count(), 100_000, spark)
    ranged = settle(ordered.repartitionByRange(n, "_null", "_source").withColumn("_part", F.spark_partition_id()))
    offsets = before(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), [], "_part", "_n", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_source")) - 1
    placed = ranged.withColumn("_inside", inside).join(offsets.select("_part", "_before"), "_part")
    turn = F.array(*map(F.lit, weights))
    weighed = settle(placed.select("_source", "source_size", F.get(turn, (F.col("_before") + F.col("_inside")).cast("bigint") % len(weights)).cast("double").alias("_weight")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    cap, weight = F.col("source_size") * float(repeats), F.col("_weight")
    level, capped = 0.0, -1
    while total:
        full = cap < weight * level
        row = weighed.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(weight)).alias("open"),
                          F.sum(full.cast("bigint")).alias("n")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - row["held"]) / row["open"]
    return weighed.select("_source", "source_size", F.least(cap, weight * level).alias("target"))


def schedule(rows: DataFrame, seed: int = 42, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``rows`` (doc_id, source, size and any others) with their place in the queue of their source.

    Adds source_size, target, and _start: the words of the source before the row.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_source", source_key()).withColumn("_hash", shuffle_hash(seed))
    counted = settle(keyed.select("_source", "_hash", "size"))
    n = parts(counted.count(), ROWS_PER_SLICE, spark)
    cut = (F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint") * n / F.lit(2**32)).cast("bigint")
    sums = settle(counted.groupBy("_source", cut.alias("_slice")).agg(F.sum("size").alias("_words")))
    targets = source_targets(sums.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, repeats)
    offsets = before(sums, ["_source"], "_slice", "_words", "_before").join(targets, "_source")
    inside = Window.partitionBy("_source", "_slice").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = keyed.withColumn("_slice", cut).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    offsets = offsets.select("_source", "_slice", "_before", "source_size", "target")
    return queued.join(offsets, ["_source", "_slice"]).withColumn("_start", F.col("_before") + F.col("_inside"))


def sent(copy: int) -> Column:
    """Words that copy number ``copy`` of a document sends before virtual time 1; the document under way is cut there."""
    left = F.floor(F.col("target") + 1e-6) - copy * F.col("source_size") - F.col("_start")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint")


def finish_time(copy: int) -> Column:
    return F.when(F.col("target") > 0, (F.col("source_size") * copy + F.col("_start") + F.col("size")) / F.col("target"))


def mix_plan(docs: DataFrame, seed: int = 42, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and finish (virtual time of its first copy), in order of finish."""
    rows = settle(docs.select("doc_id", "source", n_words().alias("size")))
    placed = schedule(rows, seed, weights, repeats)
    taken = sum((sent(c) for c in range(repeats)), F.lit(0).cast("bigint"))
    out = placed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"), F.round(finish_time(0), 9).alias("finish"))
    return out.orderBy("finish", "doc_id")


def mix_documents(docs: DataFrame, seed: int = 42, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mixed corpus: whole copies of documents with all columns of ``docs``, range-sorted by virtual finish time.

    Documents are not cut here: the copy under way at virtual time 1 is taken
    when at least half of it is sent by then.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("source"), n_words().alias("size"))
    placed = schedule(packed, seed, weights, repeats)
    copies = F.filter(F.array(*[F.when((F.col("size") > 0) & (2 * sent(c) >= F.col("size")), finish_time(c)) for c in range(repeats)]), lambda f: f.isNotNull())
    mixed = placed.select("_row", F.explode(copies).alias("_finish"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "_finish").sortWithinPartitions("_finish").select("_row.*")
