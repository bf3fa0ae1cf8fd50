"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by the
SHA-256 of the text.  A batch is taken in slices, the largest doc_ids first.  A
slice is reduced to one row per digest and meets the index, which holds the
earlier slices and batches, in a sort-merge anti-join for which the index is not
moved; the digests that are new are appended with the name of the batch.  The
row that the index holds is the one that stays.  A batch that comes again under
its name, after a failure or not, appends nothing twice and is decided alike.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z only; the row with the largest doc_id stays (a null doc_id is
smaller than any other, -1 too); of rows that repeat both doc_id and text one is kept;
an empty table gives an empty result and leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm.common import LOWER, UPPER, fresh, text_of
from segstats.scale import settle

SCHEMA = "digest binary, keep_id bigint, group_size bigint, batch string"
SLICES = 4


def digest(text: Column) -> Column:
    """32 bytes: SHA-256 of the text with A-Z in lower case."""
    return F.unhex(F.sha2(F.translate(text, UPPER, LOWER), 256))


class DigestIndex:
    """Digests seen so far, as a table bucketed and sorted by digest; without a name, a table that goes when its batch is decided."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.passing = spark, name is None
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.table(self.name)

    def append(self, fresh_rows: DataFrame) -> None:
        """New digests, written in buckets."""
        rows = fresh_rows.repartition(self.buckets, "digest")  # the hash of the buckets: one file for each
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def done(self) -> None:
        if self.passing:
            self.spark.sql(f"drop table if exists {self.name}")


def _slices(rows: DataFrame, n: int) -> list[DataFrame]:
    """``rows`` in up to ``n`` ranges of doc_id, the largest first, null last; the cut values are approximate quantiles."""
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)])).first()[0] or []), reverse=True) if n > 1 else []
    if not cuts:
        return [rows]
    doc = F.col("doc_id")
    return [rows.where(doc > cuts[0]), *[rows.where((doc <= high) & (doc > low)) for high, low in zip(cuts, cuts[1:])], rows.where((doc <= cuts[-1]) | doc.isNull())]


def ingest(docs: DataFrame, index: DigestIndex, batch: str | None = None, slices: int = SLICES) -> DataFrame:
    """Take ``docs`` into the index; per (digest, doc_id): n rows, keep_id, group_size in the batch, and whether an earlier batch has it (``known``)."""
    batch = batch or uuid.uuid4().hex
    rows = settle(docs.select(digest(text_of()).alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"))
                  .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    for part in _slices(rows, slices):
        best = part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).withColumn("batch", F.lit(batch))
        index.append(settle(best.join(index.read().select("digest").hint("merge"), "digest", "left_anti")))
    sizes = rows.groupBy("digest").agg(F.sum("n").alias("group_size"))
    held = index.read().select("digest", "keep_id", (F.col("batch") != batch).alias("known"))
    decided = settle(sizes.join(held, "digest"))
    index.done()
    return _by_digest(rows, decided)


def _by_digest(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Give each row its group; the rows of a hot digest are split at run time, its one decision is copied to the pieces."""
    return rows.join(decided, "digest")


def decisions(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = ingest(docs, index, batch)
    each = found.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    kept = ~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_seen(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = ingest(docs, index, batch).where(~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    mark, null, ident, many = fresh(docs, "_digest", "_null", "_keep_id", "_repeats")
    keep = found.select(F.col("digest").alias(mark), F.col("keep_id").isNull().alias(null), F.coalesce("keep_id", F.lit(0)).alias(ident), (F.col("n") > 1).alias(many))
    doc = F.col("doc_id").cast("bigint")
    marked = docs.withColumns({mark: digest(text_of()), null: doc.isNull(), ident: F.coalesce(doc, F.lit(0))})
    stay = marked.join(keep, [mark, null, ident])
    once = stay.where(~F.col(many)).unionByName(stay.where(F.col(many)).dropDuplicates([mark, null, ident]))
    return once.select(*docs.columns)
