"""Deduplication, profiles, histograms, ranks and leave-one-out aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def dedup_latest(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one of greatest ``order``, further ties by all kept columns.

    The row is a maximum over a struct, so copies of a hot key collapse before
    the shuffle and no task sorts the rows of a key. Null keys form one group;
    a null order counts as least.
    """
    keep = [c for c in (keep or df.columns) if c not in key and c not in order]
    top = F.max(F.struct(*order, *keep)).alias("_t")
    return df.groupBy(*key).agg(top).select(*key, "_t.*")


def latest_snapshot(df: DataFrame, entity: str, period: str, load: str, keep: Sequence[str]) -> DataFrame:
    """The last period's row of each entity, of reloads the last load."""
    return dedup_latest(df, [entity], [period, load], keep)


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``column`` values per ``row``, absent ones 0; the values are given, so no job collects them."""
    return df.groupBy(row).agg(*[F.coalesce(F.count(F.when(F.col(column) == v, 1)), F.lit(0)).alias(v) for v in values])


def histogram(df: DataFrame, value: str, width: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """bucket, rows: counts per ``floor(value / width) * width``, within inclusive bounds where given. Null values have no bucket."""
    v = F.col(value)
    if low is not None:
        df = df.where(v.between(low, high))
    return df.where(v.isNotNull()).groupBy((F.floor(v / width) * width).cast("double").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_stats(df: DataFrame, key: str, file: str, mark: str) -> DataFrame:
    """One row: identifiers delivered more than once and rows of files whose name holds ``mark``."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(file).contains(mark), 1)).alias("m"))
    return per_key.agg(F.count(F.when((F.col("n") > 1) & F.col(key).isNotNull(), 1)).alias("duplicated"), F.coalesce(F.sum("m"), F.lit(0)).alias("marked_rows"))


def variation(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column per entity."""
    return df.groupBy(entity).agg(*[F.countDistinct(c).alias(f"{c}_values") for c in columns])


def variation_summary(varied: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: entities, and entities with more than one value of each column."""
    return varied.agg(F.count(F.lit(1)).alias("entities"), *[F.coalesce(F.sum((F.col(f"{c}_values") > 1).cast("long")), F.lit(0)).alias(f"{c}_varied") for c in columns])


def top_counts(df: DataFrame, value: Column, name: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), name).limit(k)


def leave_one_out(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of ``value`` over the other rows of the group, 0 for a lone row; nulls count as missing.

    Group sums are joined back, so a group of any size is no single task.
    """
    g = df.groupBy(*group).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = df.join(g, list(group))
    return j.withColumn(out, F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).otherwise(0.0)).drop("_s", "_n")


def rank_rows(df: DataFrame, order: Sequence[Column], out: str, parts: int = 64) -> DataFrame:
    """Consecutive ranks from 1 over a global order, without one task for all rows.

    Rows are range-partitioned by the order, ranked within their range and
    moved on by the rows of the ranges before (one small table of range sizes).
    The order must be total.
    """
    r = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    r = r.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_b"))
    return r.join(F.broadcast(before), "_p").withColumn(out, F.col("_k") + F.col("_b")).drop("_p", "_k", "_b")


def quantile_cuts(df: DataFrame, value: str, at: Sequence[float]) -> DataFrame:
    """One row with the exact quantiles (linear interpolation) as ``q<percent>``."""
    q = df.agg(F.percentile(value, F.array(*[F.lit(float(a)) for a in at])).alias("_q"))
    return q.select(*[F.get("_q", i).alias(f"q{round(a * 100)}") for i, a in enumerate(at)])


def optional_filter(df: DataFrame, equals: Mapping[str, str]) -> DataFrame:
    """Equality per column, left out where the parameter is empty."""
    for c, v in equals.items():
        if v != "":
            df = df.where(F.col(c) == v)
    return df


def contains_or_prefix(text: Column, ident: Column, sought: str) -> Column:
    """Text contains the sought words without case, or the identifier begins with them; empty finds all. Taken literally."""
    return F.lit(True) if sought == "" else F.lower(text).contains(sought.lower()) | ident.cast("string").startswith(sought)


def is_active(left: Column, as_of: Column) -> Column:
    """Not left, or left after the moment given."""
    return left.isNull() | (left > as_of)
