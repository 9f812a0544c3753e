"""Named tables: reading, saving, inventory, layouts, partitions, bound queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def save_table(df: DataFrame, name: str, comment: str = "", partition_by: Sequence[str] = ()) -> DataFrame:
    """Overwrites table and schema, sets its comment and returns it read back.

    The row count is not taken in a second job: ``row_count`` reads it from the
    file footers when asked.
    """
    writer = df.write.mode("overwrite").option("overwriteSchema", "true").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format("parquet").saveAsTable(name)
    spark = df.sparkSession
    if comment:
        escaped = comment.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"COMMENT ON TABLE {name} IS '{escaped}'")
    return spark.table(name)


def row_count(df: DataFrame) -> int:
    return df.count()


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, rows, columns of each frame, most rows first, as one plan of partial counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("rows"), "table")


def parse_layout(text: str) -> T.StructType:
    """``"name type, name type"`` as a schema."""
    return T.StructType.fromDDL(text)


def conform(df: DataFrame, layout: T.StructType | str) -> DataFrame:
    """The layout's columns in its order, cast; columns the frame lacks are typed nulls, columns it has beyond are dropped.

    Values that do not cast become null. Names are matched without case.
    """
    layout = parse_layout(layout) if isinstance(layout, str) else layout
    own = {c.lower(): c for c in df.columns}
    cols = [F.col(f"`{own[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in own else F.lit(None).cast(f.dataType) for f in layout]
    return df.select(*[c.alias(f.name) for c, f in zip(cols, layout, strict=True)])


def with_load_columns(df: DataFrame, loaded: str, file: str) -> DataFrame:
    """Adds the load-control columns: day of load, file of origin, sequence hash of the row."""
    return df.withColumns({"dt_crga": F.lit(loaded), "nm_arqv_orgm": F.lit(file), "cd_hash_linha": F.sha2(F.to_json(F.struct(*df.columns)), 256)})


def reprocessed(df: DataFrame, share: float, seed: int, suffix: str = "REPROC") -> DataFrame:
    """The rows and, for a hashed share of them, copies from a reprocessed file."""
    pick = F.pmod(F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns))), F.lit(1_000_000)) < int(share * 1_000_000)
    again = df.where(pick).withColumn("nm_arqv_orgm", F.concat("nm_arqv_orgm", F.lit("." + suffix)))
    return df.unionByName(again)


def literal(spark: SparkSession, ddl: str, rows: Sequence[tuple]) -> DataFrame:
    """A small relation from literals."""
    return spark.createDataFrame([tuple(r) for r in rows], ddl)


def bounded_pandas(df: DataFrame, limit: int = 1_000_000):
    """A frame of stated size on the driver; more rows than ``limit`` is an error, not a cut."""
    got = df.limit(limit + 1).toPandas()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    return got


def serve(spark: SparkSession, text: str, views: Mapping[str, DataFrame], **args) -> DataFrame:
    """A query text with bound parameters (``:name``) over frames given as views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


def declared_key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are not unique, with their rows: the check behind a declared one-to-one or many-to-one join."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def page(df: DataFrame, order: Sequence, number: int, size: int = 15) -> DataFrame:
    """One page of an ordered bounded result (numbers from 1)."""
    return df.withColumn("_rn", F.row_number().over(W.orderBy(*order))).where(F.col("_rn").between((number - 1) * size + 1, number * size)).drop("_rn")
