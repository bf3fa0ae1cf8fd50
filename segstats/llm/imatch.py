"""I-Match document fingerprints, in DataFrame operations only.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies in
a band.  The upper end is relative to the number of documents, so the lexicon
stays below (mean distinct terms of a document) x exp(upper end) terms however
large the corpus is; it is broadcast when its counted size is below a limit and
joined by shuffle beyond.  The distinct lexicon terms of a text are sorted and
hashed once for the whole lexicon and once for each of several random subsets of
it, at four densities: long texts differ in the dense subsets after few edits,
short texts have no terms in the sparse ones, and the share of equal hashes
grades what two texts have in common.  A text with more lexicon terms than the
sparsest of these subsets thins has further levels, each a quarter as dense,
until a subset has about one of its terms; two texts are compared on the levels
that both have.

The document before and the document after meet in ranges of doc_id: one shuffle
of the texts by range, a window inside it, and one extra row per range that is
the head of the next range.

Defined results: null text is empty; terms are the words in lower case; a text
without lexicon terms is hashed as one term made of all its distinct terms; texts
without words have the fingerprint of only zeros, and two of them have likeness 1; documents follow each other by descending doc_id, then SHA-256 of the text, null
doc_id last, and the first follows the last; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import parts, range_bounds, range_number, text_of
from segstats.scale import settle

#: Kept terms stand in 1/2000 to 37 % of the documents.
IDF_BAND = (1.0, math.log(2000))
#: (bits skipped in the term hash, terms of the lexicon per term of a subset, subsets)
DENSITIES = ((0, 1, 1), (3, 4, 2), (8, 16, 5), (14, 64, 16), (22, 256, 32))
#: Each further level has a quarter of the terms of the one before, in so many subsets.
FURTHER = 32
BROADCAST_TERMS = 2_000_000
ROWS_PER_RANGE = 50_000
_EMPTY = 42  # what xxhash64 gives for an empty array


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+")), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Terms of ``docs`` (column ``text``) in the band, as ``term``; counts of all documents, combined before the shuffle."""
    n = docs.count()
    counts = docs.select(F.explode(terms(text_of())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.where((F.col("df") <= n * math.exp(-band[0])) & (F.col("df") >= n * math.exp(-band[1]))).select("term")


def subset_hashes(found: Column) -> Column:
    """From the sorted lexicon terms of a text: a 32-bit hash for each subset, 0 where it has no term; long texts have further subsets."""

    def place(t: Column, skip: int, density: int) -> Column:
        return F.call_function("shiftright", t, F.lit(skip)).bitwiseAND(F.lit(density - 1))

    def hashed(mine: Column) -> Column:
        h = F.xxhash64(mine)
        return F.when(h == _EMPTY, F.lit(0).cast("bigint")).otherwise(h.bitwiseAND(F.lit(0xFFFFFFFF)))

    out = []
    for skip, density, many in DENSITIES:
        if density == 1:
            out.append(F.array(hashed(found)))
            continue
        # First the terms of any subset of this density, then those of each.
        some = F.filter(found, lambda t: place(t, skip, density) < many)  # noqa: B023
        out.append(F.transform(F.array(some), lambda s: F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: hashed(  # noqa: B023
            F.filter(s, lambda t: place(t, skip, density) == i))))[0])  # noqa: B023

    def thinned(level: Column) -> Column:
        # The terms of any subset of the level, with their subset, from a hash of its own for each level.
        share = F.pow(F.lit(4.0), level).cast("bigint") * DENSITIES[-1][1]
        placed = F.transform(found, lambda t: F.struct(t.alias("t"), F.pmod(F.xxhash64(t, level), share).alias("i")))
        some = F.filter(placed, lambda v: v["i"] < FURTHER)
        return F.flatten(F.transform(F.array(some), lambda s: F.transform(F.sequence(F.lit(0), F.lit(FURTHER - 1)), lambda i: hashed(
            F.transform(F.filter(s, lambda v: v["i"] == i), lambda v: v["t"])))))

    # One level for each factor of 4, begun or whole, above the sparsest density.
    levels = F.ceil(F.log(4.0, F.size(found) / F.lit(DENSITIES[-1][1])) - 1e-9).cast("int")
    none = F.array().cast("array<bigint>")
    further = F.when(F.size(found) > DENSITIES[-1][1], F.flatten(F.transform(F.sequence(F.lit(1), levels), thinned))).otherwise(none)
    return F.concat(*out, further)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with terms in either text whose hashes are equal, over the levels of both."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda v: v))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda v: v))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) by range, with next_text; rows with ``_extra`` 1 only stand for the document after the range."""
    spark = docs.sparkSession
    many = parts(docs.count(), ROWS_PER_RANGE, spark)
    placed = docs.select(range_number(F.col("doc_id"), range_bounds(docs, "doc_id", many)).alias("_range"), "doc_id", "text")
    # One row per range: its largest doc_id, and the range before it in descending order.
    heads = settle(placed.groupBy("_range").agg(F.max("doc_id").alias("_head")))
    around = Window.partitionBy(F.lit(0)).orderBy("_range")
    last = F.max("_range").over(Window.partitionBy(F.lit(0)))
    lowest = F.min("_range").over(Window.partitionBy(F.lit(0)))
    before = settle(heads.select("_head", F.when(F.col("_range") == last, lowest).otherwise(F.lead("_range").over(around)).alias("_range")))
    found = docs.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_head")))  # a row for each range
    extra = found.groupBy("_range", "doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select("_range", "doc_id", "text", F.lit(1).alias("_extra"))
    rows = placed.select("*", F.lit(0).alias("_extra")).unionByName(extra)
    return rows.withColumn("next_text", F.lead("text").over(_descending()))


def _descending() -> Window:
    return Window.partitionBy("_range").orderBy("_extra", F.desc_nulls_last("doc_id"), F.sha2("text", 256))


def edited(text: Column, other: Column) -> Column:
    """The last half of the code points replaced by the first as many, or all, of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("string").alias("text"))
    kept = settle(lexicon(docs, band))
    mark = F.lit(0).cast("bigint")  # a term of every text, so that none without lexicon terms is lost
    words = kept.unionByName(docs.sparkSession.range(1).select(mark.alias("term"))).distinct()
    if kept.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    pairs = with_next(docs).withColumn("_edited", edited(F.col("text"), text_of("next_text")))
    pairs = pairs.withColumns({"_terms": terms(F.col("text")), "_edited_terms": terms(F.col("_edited"))})
    whole = lambda found: F.when(F.size(found) > 0, F.xxhash64(F.sort_array(found)))
    info = F.struct("_extra", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("_own"),
                    whole(F.col("_terms")).alias("_whole"), whole(F.col("_edited_terms")).alias("_edited_whole"))
    of = lambda found, side: F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(side).alias("side")))
    # A row for each term of either text; what belongs to the document itself goes with a row of its own.
    texts = pairs.select("_range", F.monotonically_increasing_id().alias("_row"), F.concat(of("_terms", 0), of("_edited_terms", 1), F.array(F.struct(mark.alias("term"), F.lit(2).alias("side")))).alias("terms"), info.alias("info"))
    rows = texts.select("_range", "_row", F.explode("terms").alias("t"), "info").select("_range", "_row", "t.term", "t.side", F.when(F.col("t.side") == 2, F.col("info")).alias("info"))
    each = rows.join(words, "term").groupBy("_range", "_row").agg(
        F.first("info", ignorenulls=True).alias("info"),
        F.collect_list(F.when(F.col("side") == 0, F.col("term"))).alias("own"), F.collect_list(F.when(F.col("side") == 1, F.col("term"))).alias("changed"))
    # In place of no lexicon term: all terms of the text as one.
    held = lambda found, instead: F.when((F.size(found) == 0) & F.col(instead).isNotNull(), F.array(instead)).otherwise(F.sort_array(found))
    each = each.select("_range", "info.*", held("own", "info._whole").alias("own"), held("changed", "info._edited_whole").alias("changed"))
    hashed = each.withColumns({"own": subset_hashes(F.col("own")), "changed": subset_hashes(F.col("changed"))})
    order = Window.partitionBy("_range").orderBy("_extra", F.desc_nulls_last("doc_id"), "_own")
    full = hashed.withColumn("next", F.lead("own").over(order)).where(F.col("_extra") == 0)
    return full.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
                       F.round(likeness(F.col("own"), F.col("changed")), 6).alias("near_edited"), F.round(likeness(F.col("own"), F.col("next")), 6).alias("near_next"))
