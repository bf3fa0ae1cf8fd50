"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segstats.scale import configure

#: A word: what the six ASCII white-space bytes leave.  ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_BATCH = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings of the operators: split skewed joins, and bound the documents in one Arrow batch."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def drop_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of a query when it ends: what operators keep between their jobs is written as tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(rows: int, rows_per_part: int, spark: SparkSession) -> int:
    """Number of parts of about ``rows_per_part`` rows, two for each shuffle partition at least if there are rows for them.

    It grows with the rows without a limit.
    """
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // rows_per_part), min(least, -(-rows // 256)))


def range_bounds(df: DataFrame, column: str, n: int) -> list:
    """Up to n - 1 cut values of a numeric column, approximate quantiles of all its rows."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_number(value: Column, bounds: Sequence) -> Column:
    """How many of the sorted ``bounds`` are <= value (null: 0), found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [list(bounds[i : i + width]) for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    nested = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    block = F.size(F.filter(heads, lambda h: h <= value))
    inside = F.size(F.filter(F.get(nested, block - 1), lambda b: b <= value))
    return F.when(value.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * F.lit(width) + inside).cast("int")


def before(counts: DataFrame, by: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """``counts`` with the sum of ``value`` over the smaller ``order`` of the same ``by``; meant for one row per part."""
    keys = [F.col(c) for c in by] or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
