"""Registry of queries: a Spark function and, where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.plans import fixtures
from segstats.scale import configure, measured_broadcasts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """The driver's tables and the views derived from them, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.spread_by = ["image_id", "gt_idx"]
        configure(spark)
        measured_broadcasts(spark)

    def by_image(self) -> Source:
        """The same tables, with polygons spread by image: what is grouped by image needs no second shuffle."""
        other = Source(self.spark, self.sf_dir)
        other.spread_by = ["image_id"]
        return other

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, view: str) -> DataFrame:
        return fixtures.view(self, view)


def query(sql: str | None = None) -> Callable:
    """Register ``fn(source)`` under its own name; ``sql`` may use the fixture views as fx_<name>."""

    def register(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = fixtures.with_views(sql)
        return fn

    return register


def r6(col: Column | str) -> Column:
    """Doubles are compared to six places (and never as -0.0)."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def big(df: DataFrame, *names: str) -> DataFrame:
    """Integers as bigint, whichever width an engine gives them."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})
