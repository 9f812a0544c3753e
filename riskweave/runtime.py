"""Session defaults, table access, lineage cuts and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast on purpose only below this many bytes of estimated size.
BROADCAST_BYTES = 8 << 20


def session(app: str = "riskweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew-join handling."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; a file or a directory of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local master, whose executor is this machine, gets a local one where it is unset.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "riskweave-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        p, fs = _fs(spark, path)
        fs.delete(p, True)


class Cuts:
    """Tables written to the shared folder in place of a long lineage.

    ``put`` writes a frame and returns it read back; the files outlive lost
    executors. ``drop`` removes tables whose readers have all run.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """Several cut tables of one schema as one scan."""
        return self.spark.read.schema(frames[0].schema).parquet(*[f._cut_path for f in frames])

    def drop(self, *frames: DataFrame) -> None:
        remove(self.spark, *(f._cut_path for f in frames if hasattr(f, "_cut_path")))


def apart(df: DataFrame) -> DataFrame:
    """The frame, its join a sort-merge join whatever its estimated size.

    For sides that grow with the data: Spark takes their size from compressed
    files and leaves out the rows that ``explode`` or a Python function adds, so
    a vocabulary of a few hundred kB goes to the driver as all its keys.
    """
    return df.hint("merge")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; an upper-bound style guess, exact for files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a broadcast of the frame is allowed."""
    return estimated_bytes(df) <= limit
