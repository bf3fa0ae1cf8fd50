"""Building blocks that keep one hot key from landing in one task.

* ``skew_join``      equi-join on keys that may be hot;
* ``running``        running aggregates as a prefix scan over chunks of bounded size, to any depth;
* ``kth_smallest``   the k-th row of a hash order without sorting the table;
* ``parted``         rows of small keys, which a row can hold, and those of the others;
* ``batched_by``     rows of a key that stand together as one row, before they are shuffled;
* ``in_calls``       a function on the rows of many small keys at a time, which are shuffled packed;
* ``settle``         table written to the checkpoint folder the cluster names;
* ``until_stable``   fixpoint loop over settled rounds.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS_PER_CHUNK = 2_000_000
#: Rows of a key that are brought together in one row; larger keys go through joins.
ROWS_PER_GROUP = 1_000
#: Rows of small keys that one call takes together, on average.
ROWS_PER_CALL = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder named by the session; a private one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="segstats-checkpoint-")
    sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Cuts the lineage and survives executor loss like ``checkpoint()``, but stays
    columnar, so readers take only the columns they need and plan with real sizes.
    With ``buckets`` (number, column), which ``df`` should be partitioned by, joins on
    that column do not move the table.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    if buckets is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        name = f"settled_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(*buckets).option("path", path).saveAsTable(name)
        out = spark.table(name)
    out._settled = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`settle` returned; frames that read it must not be used any more."""
    path = getattr(df, "_settled", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def until_stable(
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    unfinished: Callable[[DataFrame], Column],
    max_rounds: int = 1000,
) -> DataFrame:
    """Apply ``step`` until no row is ``unfinished``; every round is settled, and only the last one stays."""
    state = settle(state)
    for _ in range(max_rounds):
        if state.where(unfinished(state)).isEmpty():
            return state
        before, state = state, settle(step(state))
        forget(before)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def configure(spark: SparkSession) -> None:
    """Session settings the joins count on: runtime splitting of skewed partitions, also
    where the split costs another shuffle."""
    for key in ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{key}", "true")
    ship(spark)


def measured_broadcasts(spark: SparkSession) -> None:
    """Broadcasts by the size a finished stage has, not by the estimate of a plan, which knows
    neither how well a file is packed nor how many rows an ``explode`` makes."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each context; Spark's own file server copies it to them."""
    sc = spark.sparkContext
    if getattr(sc, "_segstats_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="segstats-package-"), "segstats.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._segstats_shipped = True


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ids: Sequence[str],
    right_ids: Sequence[str] | None = None,
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Equi-join on keys that may be hot.

    A hot key makes a skewed shuffle partition, which Spark cuts at run time into
    pieces on either side (see :func:`configure`).  ``salts`` > 1 cuts every key
    beforehand, for sessions that cannot do that: left rows go to the salt of a
    hash of their ids and meet one copy of the right rows there; with
    ``right_ids`` (inner joins) the right rows are cut too, into salts ** 2 meetings.
    """
    if salts <= 1:
        spark = left.sparkSession
        if spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") != "true" or spark.conf.get("spark.sql.adaptive.enabled") != "true":
            configure(spark)  # a session that was not prepared would leave the hot key whole
        return left.join(right, list(keys), how)
    if right_ids is not None and how != "inner":
        raise ValueError("both sides can be cut in an inner join only")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = left.withColumn("_s1", F.pmod(F.xxhash64(*left_ids), F.lit(salts)).cast("int"))
    right = right.withColumn("_s1", every)
    names = ["_s1"]
    if right_ids is not None:
        left = left.withColumn("_s2", every)
        right = right.withColumn("_s2", F.pmod(F.xxhash64(*right_ids), F.lit(salts)).cast("int"))
        names.append("_s2")
    return left.join(right, [*keys, *names], how).drop(*names)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ids: Sequence[str], how: str = "left",
           salts: int = 1) -> DataFrame:
    """Look up one ``right`` row per key for every ``left`` row."""
    return skew_join(left, right, keys, left_ids, how=how, salts=salts)


def has_null(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])


def parted(frames: Sequence[DataFrame], by: Sequence[str], rows_per_group: int = ROWS_PER_GROUP,
           nulls: bool = False, counted: DataFrame | None = None) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The frames cut by key: keys with at most ``rows_per_group`` rows in all frames, and the larger ones (None if there are none).

    Rows with a null key are left out, as a join leaves them out.  With ``nulls``
    they count as a large key, and so does every key that has a null in any column.
    ``counted`` (keys, ``_n``, ``_odd``) spares the count where it is known.
    """
    known = list(frames) if nulls else [f.where(~has_null(by)) for f in frames]
    if counted is None:
        keys = reduce(lambda a, b: a.unionByName(b), [f.select(*by, (has_null(f.columns) if nulls else F.lit(False)).alias("_odd")) for f in known])
        counted = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("_odd").alias("_odd"))
    large = settle(counted.where((F.col("_n") > rows_per_group) | F.col("_odd")).select(*[F.col(k).alias(f"_large_{k}") for k in by]))
    if large.isEmpty():
        forget(large)
        return known, None
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in by])
    return [f.join(large, same, "left_anti") for f in known], [f.join(large, same, "left_semi") for f in known]


def packed_by(df: DataFrame, by: Sequence[str], *columns: str, out: str = "members") -> DataFrame:
    """One row per key with the list of its rows."""
    return df.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias(out))


def batched_by(df: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """Rows of a key that stand in one Arrow batch as one row, each column as the bytes of its numbers; a key may have several rows.

    Columns are bigint or double, without nulls; :func:`segstats.functions.groups.numbers` reads them.
    """
    names = [*by, *columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in by]
            order = np.lexsort(codes[::-1])
            new = np.any([np.r_[True, c[order][1:] != c[order][:-1]] for c in codes], axis=0)
            first = np.flatnonzero(new)
            ends = pa.py_buffer((np.r_[first, batch.num_rows] * 8).astype(np.int32))
            numbers = [np.ascontiguousarray(batch.column(c).to_numpy()[order]) for c in columns]
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(n)]) for n in numbers]
            yield pa.record_batch([*[batch.column(c).take(pa.array(order[first])) for c in by], *packed], names=names)

    return df.select(*names).mapInArrow(pack, f"{fields(df, by)}, {', '.join(f'`{c}` binary' for c in columns)}")


def in_calls(frames: Sequence[DataFrame], key: str, work: Callable, schema: T.StructType, rows_per_group: int = ROWS_PER_GROUP) -> tuple[DataFrame, list[DataFrame] | None]:
    """``work`` on the rows of many small keys at a time, and the frames of the larger keys, or those with nulls (None if there are none).

    ``frames`` hold the key and numbers (see :func:`are_numbers`).  Rows are
    packed where they stand and shuffled once.  ``work`` gets for each frame the
    numbers of its keys, which are equal in all frames, and its columns, and
    returns the same for ``schema``, whose first field is the key.
    """
    from segstats.functions.groups import numbers

    keys = reduce(DataFrame.unionByName, [f.select(key, has_null(f.columns).alias("_odd")) for f in frames])
    counted = settle(keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("_odd").alias("_odd")))
    small, large = parted(frames, [key], rows_per_group, nulls=True, counted=counted)
    rows = counted.where(F.col("_n") <= rows_per_group).agg(F.sum("_n")).first()[0] or 0
    forget(counted)
    call = F.pmod(F.xxhash64(F.lit(37), key), F.lit(rows // ROWS_PER_CALL + 1)).cast("bigint").alias("_call")
    kinds = [[np.float64 if f.schema[c].dataType.simpleString() in ("float", "double") else np.int64 for c in f.columns if c != key] for f in frames]
    names = [f"_c{k}" for k in range(max(map(len, kinds)))]

    def packed(df: DataFrame, number: int) -> DataFrame:
        columns = [F.col(c).cast("double" if kind is np.float64 else "bigint").alias(n) for n, c, kind in zip(names, [c for c in df.columns if c != key], kinds[number])]
        mine = names[: len(columns)]
        return batched_by(df.select(key, *columns), [key], *mine).select(call, key, F.lit(number).alias("_frame"), *[F.col(n) if n in mine else F.lit(None).cast("binary").alias(n) for n in names])

    out_schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(table: pa.Table) -> pa.Table:
        found = table[key].combine_chunks().dictionary_encode()
        codes, frame = found.indices.to_numpy(), table["_frame"].to_numpy()
        sides = []
        for number, own in enumerate(kinds):
            only = frame == number
            part = table.filter(pa.array(only)).combine_chunks()
            columns = [numbers(part[n].combine_chunks(), kind) for n, kind in zip(names, own)]
            sides.append([np.repeat(codes[only], columns[0][0]), *(c for _, c in columns)])
        row, *columns = work(*sides)
        return pa.table([a.cast(f.type, safe=False) for a, f in zip([found.dictionary.take(pa.array(row)), *map(pa.array, columns)], out_schema)], schema=out_schema)

    rows = reduce(DataFrame.unionByName, [packed(f, k) for k, f in enumerate(small)])
    return rows.groupBy("_call").applyInArrow(run, schema), large


def are_numbers(df: DataFrame, key: str) -> bool:
    """All columns but the key hold plain numbers."""
    return all(f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double") for f in df.schema.fields if f.name != key)


def fields(df: DataFrame, names: Sequence[str]) -> str:
    """Names and types of columns, for a schema string."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


_AGGS = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}


def with_chunks(df: DataFrame, order: str | Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK, by: Sequence[str] = ()) -> DataFrame:
    """Settle a table that :func:`running` will read, with ``_chunk`` when it is too big for one task per group.

    The chunks are ranges of (by, order, a number of the row), so rows that tie in
    the whole ``order`` are cut as well, a group lies in neighbouring chunks, and
    the number of chunks grows with the table without a limit.  A single name
    stands for the first of several order keys: its ties stay together.
    """
    df = settle(df)
    chunks = -(-df.count() // rows_per_chunk)
    if chunks <= 1:
        return df
    keys = [order] if isinstance(order, str) else [*order, "_tie"]
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())  # of a written table: the same in every attempt
    cut = numbered.repartitionByRange(chunks, *by, *keys).withColumn("_chunk", F.spark_partition_id()).drop("_tie")
    out = settle(cut)
    forget(df)
    return out


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, str]],
    through: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Running sum / max / min / xor along ``order`` inside each ``by`` group; null keys are a group.

    ``values`` maps an output name to (aggregate, input column); ``through``
    includes the current row, otherwise only the rows before it count.  With a
    ``_chunk`` column (see :func:`with_chunks`, called with the same ``by`` and
    ``order``) one window runs inside each (group, chunk) and the totals of the
    groups that lie in several chunks, at most two for each chunk, are carried on
    by the same function: totals of totals, to any depth.  Double sums depend on
    where a table is cut, by rounding.
    """
    inside_end = 0 if through else -1
    keys = list(by) or [F.lit(0)]
    if "_chunk" not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, inside_end)
        return df.select("*", *[_AGGS[fn](c).over(w).alias(out) for out, (fn, c) in values.items()])
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, inside_end)
    local = df.select("*", *[_AGGS[fn](c).over(inside).alias(f"_l_{out}") for out, (fn, c) in values.items()])
    carry = _carried(df, by, values, rows_per_chunk)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "_chunk"]]
    joined = local.alias("l").join(carry.alias("c"), reduce(lambda a, b: a & b, same), "left")

    def both(out: str, fn: str) -> Column:
        a, b = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if fn in ("sum", "xor"):
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b if fn == "sum" else a.bitwiseXOR(b))
        return F.greatest(a, b) if fn == "max" else F.least(a, b)

    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], *[both(out, fn).alias(out) for out, (fn, _) in values.items()])


def _carried(df: DataFrame, by: Sequence[str], values: dict[str, tuple[str, str]], rows_per_chunk: int) -> DataFrame:
    """For the groups that lie in several chunks, what the chunks before each chunk add up to."""
    totals = settle(df.groupBy(*by, F.col("_chunk").alias("_at")).agg(*[_AGGS[fn](c).alias(f"_t_{out}") for out, (fn, c) in values.items()]))
    if by:
        wide = totals.groupBy(*[F.col(k).alias(f"_w_{k}") for k in by]).agg(F.count(F.lit(1)).alias("_n_chunks")).where("_n_chunks > 1")
        totals = totals.join(wide, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in by]), "left_semi")
    cut = with_chunks(totals, ["_at"], max(2, rows_per_chunk), by)
    sums = running(cut, by, ["_at"], {f"_c_{out}": (fn, f"_t_{out}") for out, (fn, _) in values.items()}, through=False, rows_per_chunk=rows_per_chunk)
    return settle(sums.select(*by, F.col("_at").alias("_chunk"), *[f"_c_{out}" for out in values]))


def row_numbers(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "rn",
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """1-based row number along ``order``, without one task per group."""
    ones = with_chunks(df.withColumn("_one", F.lit(1).cast("bigint")), order, rows_per_chunk, by)
    return running(ones, by, order, {out: ("sum", "_one")}, rows_per_chunk=rows_per_chunk).drop("_one", "_chunk")


def kth_smallest(df: DataFrame, hash_col: str, id_col: str, k: Column) -> Column:
    """(hash, id) of the k-th row in (hash, id) order, as a scalar subquery.

    ``hash_col`` is uniform in [0, 2^32).  Rows are counted in 65,536 equal
    slices (map-side combined); only the slice that holds the k-th row is
    sorted.  NULL when k < 1 or k exceeds the number of rows.
    """
    slices = df.withColumn("_slice", F.shiftright(F.col(hash_col), 16))
    counts = slices.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_slice")  # at most 65,536 rows
    cut = (counts.select("_slice", "_n", F.sum("_n").over(w).alias("_upto"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n_rows"))
           .withColumn("_k", k)
           .where((F.col("_k") > F.col("_upto") - F.col("_n")) & (F.col("_k") <= F.col("_upto")))
           .select("_slice", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_rank")))
    inside = Window.partitionBy("_slice").orderBy(hash_col, id_col)
    row = (slices.join(F.broadcast(cut), "_slice")  # one row
           .withColumn("_rn", F.row_number().over(inside))
           .where(F.col("_rn") == F.col("_rank")))
    return row.select(F.struct(F.col(hash_col).alias("h"), F.col(id_col).alias("id"))).scalar()


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], weight: str | None = None,
              rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per (key, ``q``).

    Equal values are counted first (map-side combined); a running count then
    gives the value at each rank, so no task ever holds the values of a group.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    counts = base.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(n.alias("_n"))
    counts = with_chunks(counts, ["_v"], rows_per_chunk, keys)
    upto = running(counts, keys, ["_v"], {"_upto": ("sum", "_n")}, rows_per_chunk=rows_per_chunk)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = attach(upto, totals, keys, ["_v"], how="inner")
    asked = F.filter(F.array(*[F.lit(float(p)) for p in points]), lambda p: _holds(p, "floor") | _holds(p, "ceil"))
    hits = placed.select(*keys, "_v", "_n", "_upto", "_total", F.explode(asked).alias("q"))
    rank = F.col("q") * (F.col("_total") - 1)
    at = hits.groupBy(*keys, "q").agg(
        F.max(F.when(_holds(F.col("q"), "floor"), F.col("_v"))).alias("_low"),
        F.max(F.when(_holds(F.col("q"), "ceil"), F.col("_v"))).alias("_high"), F.max(rank - F.floor(rank)).alias("_part"))
    return at.select(*by, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))


def _holds(p: Column, side: str) -> Column:
    """The rows of the current value include rank floor/ceil(p * (n - 1))."""
    rank = p * (F.col("_total") - 1)
    at = F.floor(rank) if side == "floor" else F.ceil(rank)
    return (at >= F.col("_upto") - F.col("_n")) & (at < F.col("_upto"))


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, names: dict[str, float], weight: str | None = None,
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """:func:`quantiles` with one column per asked point."""
    long = quantiles(df, by, value, sorted(set(names.values())), weight, rows_per_chunk)
    wide = long.groupBy(*by) if by else long.groupBy()
    return wide.agg(*[F.max(F.when(F.col("q") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in names.items()])
