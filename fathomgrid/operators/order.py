"""Exact ranks and quantiles of huge groups: values are dealt by approximate splits, counts make the result exact.

A group's approximate quantiles, one mergeable sketch, split its values into buckets. Counts of the buckets, summed over
smaller ones, say which ranks a bucket holds; what remains to be sorted is one bucket. A bad split only makes a bucket
larger, never a result wrong. Equal values are counted before they are shuffled, so that ties never fill a task.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Splits of a group: STEP times STEP buckets at most; accuracy of the sketch; bytes of splits that are broadcast.
STEP, ACCURACY, BROADCAST_BYTES = 12, 10_000, 32 << 20
#: Rows of the largest group up to which no group is split.
WHOLE = 1 << 18


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names, so that it stays the same whenever it is read.

    Only a local session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp())
    return df.checkpoint()


def _bucket(value: Column) -> Column:
    """How many splits are at most value: first among every STEPth, then among the STEP that follow."""
    high = F.size(F.filter("_coarse", lambda s: s <= value))
    return high * STEP + F.size(F.filter(F.slice("_splits", high * STEP + 1, STEP), lambda s: s <= value))


def small(df: DataFrame, by: tuple[str, ...]) -> bool:
    """Whether a task can sort any group."""
    return (df.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 0) <= WHOLE


def sent(df: DataFrame) -> DataFrame:
    """df as it stays, broadcast if its rows (of few numbers) are few."""
    df = settled(df)
    return F.broadcast(df) if df.count() * 128 <= BROADCAST_BYTES else df


def counts(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Distinct values with their counts (by, _v, _n), without null."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def _counted(df: DataFrame, value: str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their counts and buckets (by, _v, _n, _bucket), and buckets with the rows below and of the group."""
    some = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    return _dealt(counts(df, value, by), some, by)


def _dealt(values: DataFrame, some: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The same from counted values; splits are those of some (by, _v)."""
    sketch = F.percentile_approx("_v", [i / (STEP * STEP) for i in range(1, STEP * STEP)], ACCURACY)
    splits = settled(some.groupBy(*by).agg(F.array_sort(sketch).alias("_splits")))
    splits = splits.withColumn("_coarse", F.filter("_splits", lambda _, i: i % STEP == STEP - 1))
    if splits.count() * STEP * STEP * 9 <= BROADCAST_BYTES:
        splits = F.broadcast(splits)
    met = values.join(splits, list(by)) if by else values.crossJoin(splits)
    values = met.select(*(values[c] for c in values.columns if c not in by), *by, _bucket(F.col("_v")).alias("_bucket"))
    sizes = values.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
    group = W.partitionBy(*by)  # a row for each bucket
    below = F.coalesce(F.sum("_size").over(group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return values, sizes.withColumn("_below", below).withColumn("_all", F.sum("_size").over(group))


def ranked(df: DataFrame, value: str, by: tuple[str, ...], name: str = "rank", count: str = "_all") -> DataFrame:
    """df with the rank (from 1, ties by their mean) of value in its group and the number of the group's values.

    Rows whose value is null have neither; by must not be null.
    """
    if small(df, by):
        some = F.col(value).isNotNull()
        ties = F.count(F.lit(1)).over(W.partitionBy(*by, value))
        rank = F.rank().over(W.partitionBy(*by).orderBy(F.asc_nulls_last(value))) + (ties - 1) / 2.0
        return df.withColumn(name, F.when(some, rank)).withColumn(count, F.when(some, F.count(value).over(W.partitionBy(*by))))
    found = _placed(*_counted(df, value, by), by).select(*by, "_v", F.col("_rank").alias(name), F.col("_all").alias(count))
    return df.withColumn("_v", F.col(value).cast("double")).join(found, [*by, "_v"], "left").drop("_v")


def _placed(values: DataFrame, buckets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Dealt values with their _rank and the number of all in their group."""
    own = W.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    inside = values.withColumn("_inside", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    found = inside.join(buckets, [*by, "_bucket"]).withColumn("_rank", F.col("_below") + F.col("_inside") + (F.col("_n") + 1) / 2)
    return found.drop("_bucket", "_inside", "_size", "_below")


def counted_ranks(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counted values (by, _v, _n and others) with _rank, as ranked gives it to their rows, and _all, the group's rows.

    values is read more than once, so it should be settled.
    """
    if small(values, by):
        group = W.partitionBy(*by)
        below = F.coalesce(F.sum("_n").over(group.orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return values.withColumn("_rank", below + (F.col("_n") + 1) / 2).withColumn("_all", F.sum("_n").over(group))
    return _placed(*_dealt(values, values, by), by)


def counted_quantiles(values: DataFrame, by: tuple[str, ...], levels: dict[str, float]) -> DataFrame:
    """quantiles of the rows that counted values stand for; values should be settled."""
    if small(values, by):
        found = values.groupBy(*by).agg(F.percentile("_v", F.array(*(F.lit(float(p)) for p in levels.values())), F.col("_n")).alias("_q"))
        return found.select(*by, *(F.col("_q")[i].alias(n) for i, n in enumerate(levels)))
    return _interpolated(*_dealt(values, values, by), by, levels)


def quantiles(df: DataFrame, value: str, by: tuple[str, ...], levels: dict[str, float]) -> DataFrame:
    """Exact quantiles of a group, interpolated between neighbouring values: (by, a column for each name of levels).

    Only buckets that hold a wanted rank are sorted. Null values don't count; a group of nulls has no row; by must not
    be null.
    """
    if small(df, by):
        found = df.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(float(p)) for p in levels.values()))).alias("_q")).filter("_q is not null")
        return found.select(*by, *(F.col("_q")[i].alias(n) for i, n in enumerate(levels)))
    return _interpolated(*_counted(df, value, by), by, levels)


def _interpolated(values: DataFrame, buckets: DataFrame, by: tuple[str, ...], levels: dict[str, float]) -> DataFrame:
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in levels.items())))
    place = F.col("_q.p") * (F.col("_all") - 1)
    wanted = buckets.withColumn("_q", asked).withColumn("_part", place - F.floor(place)).withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    wanted = wanted.withColumn("_upper", F.col("_k") > place).filter("_k >= _below AND _k < _below + _size").select(*by, "_bucket", "_below", "_q.name", "_part", "_k", "_upper")
    few = values.join(wanted.select(*by, "_bucket").distinct(), [*by, "_bucket"], "left_semi")
    own = W.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    few = few.withColumn("_first", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    hits = few.join(wanted, [*by, "_bucket"]).filter("_k - _below >= _first AND _k - _below < _first + _n")
    low, high = (F.max(F.when(c, F.col("_v"))) for c in (~F.col("_upper"), F.col("_upper")))
    each = hits.groupBy(*by, "name").agg(low.alias("_lo"), high.alias("_hi"), F.max("_part").alias("_part"))
    each = each.withColumn("_x", F.coalesce(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"), F.col("_lo")))
    return each.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("_x"))).alias(n) for n in levels))
