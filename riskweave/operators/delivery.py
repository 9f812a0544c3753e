"""Messages delivered more than once.

Identifiers are dictionary-encoded exactly, per shard; a shard's seen-bitmaps
hold one bit per code. Of a batch, one arrival of each identifier whose bit is
unset is admitted, and the new bits become visible with the new codes by one
atomically created manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from riskweave.runtime import _fs, estimated_bytes, remove, shared_dir, small

DICTIONARY = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("code", T.LongType())])
BITMAPS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])
#: Bytes of a first batch per shard, and the deltas after which the state is written whole.
SHARD_BYTES, COMPACT_AFTER = 32 << 20, 16


def message_id(c: Column) -> Column:
    """Lower case without surrounding blanks of any kind; empty counts as null."""
    blank = r"[\s\x{A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]"
    return F.nullif(F.lower(F.regexp_replace(c, f"^{blank}+|{blank}+$", "")), F.lit(""))


class StaleLedger(RuntimeError):
    """Another batch was committed since this one read the state."""


class SeenLedger:
    """Exact at-most-once admission over batches.

    State: ``dictionary`` (shard, id, code) and ``seen`` (shard, bucket, bits)
    with one 32 768-bit map per bucket, as deltas per batch. ``manifest-N``
    lists the deltas of version N, the shard count and each shard's next code.
    It is created exclusively: a batch that read version N can only commit
    N + 1, a second writer fails with ``StaleLedger``, and a failed batch leaves
    the former version valid. A batch writes what is new only; after
    ``COMPACT_AFTER`` deltas the state is written whole.

    The shard count belongs to the state: it is set by the first batch (from
    ``shards``, else from its size) and a later differing value is an error.
    Identifiers of any length are kept whole; null ones are not identifiers and
    are left to the caller. Hot identifiers collapse in the partial aggregate;
    shards spread by hash.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None):
        self.spark, self.wanted = spark, shards
        self.path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex[:12]}"

    def version(self) -> int:
        """The number of committed batches."""
        p, fs = _fs(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[9:]) for n in names if n.startswith("manifest-")), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"dictionary": [], "seen": [], "next": None, "shards": None}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest-{version}").collect()))

    def _seen(self, m: dict) -> DataFrame | None:
        if not m["seen"]:
            return None
        return self.spark.read.schema(BITMAPS).parquet(*[f"{self.path}/{x}" for x in m["seen"]]).groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def admit(self, batch: DataFrame, id_col: str, order: Sequence[Column], payload: Sequence[str] = (), token: str | None = None) -> DataFrame:
        """One row per identifier of the batch: id, arrivals, admitted (its bit was unset), payload of the first arrival.

        The first arrival is the least by ``order`` then payload, so ties and
        full copies give one defined result. Runs the batch and commits the
        state. A batch repeated with the ``token`` of the last commit gets that
        commit's answer again and changes nothing.
        """
        spark = self.spark
        base = self.version()
        m = self._manifest(base)
        answer = lambda coded: coded.select("id", "arrivals", "admitted", *[F.col(f"_first._p{i}").alias(p) for i, p in enumerate(payload)])
        if token is not None and m.get("token") == token:
            return answer(spark.read.parquet(f"{self.path}/{m['at']}/coded"))
        shards = m["shards"] or self.wanted or max(8, -(-estimated_bytes(batch) // SHARD_BYTES))
        if self.wanted and m["shards"] and self.wanted != m["shards"]:
            raise ValueError(f"the ledger has {m['shards']} shards, not {self.wanted}")
        at = f"{base + 1}-{uuid.uuid4().hex[:8]}"
        put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{at}/{name}")

        shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
        first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(p).alias(f"_p{i}") for i, p in enumerate(payload)])).alias("_first")
        ids = batch.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("arrivals"), first).select(shard, "id", "arrivals", "_first")

        # encode: known identifiers by the dictionary, new ones with the next codes of their shard
        if m["dictionary"]:
            known = spark.read.schema(DICTIONARY).parquet(*[f"{self.path}/{x}" for x in m["dictionary"]])
            coded = ids.join(known, ["shard", "id"], "left")
        else:
            coded = ids.withColumn("code", F.lit(None).cast("long"))
        start = F.get(F.array(*[F.lit(x).cast("long") for x in (m["next"] or [0] * shards)]), F.col("shard"))
        place = F.row_number().over(W.partitionBy("shard", F.col("code").isNull()).orderBy("id"))
        coded = coded.withColumn("new", F.col("code").isNull()).withColumn("code", F.coalesce("code", start + place - 1))

        # decide: the bit of the code, whoever gave it
        coded = coded.withColumn("bucket", F.expr("bitmap_bucket_number(code + 1)")).withColumn("position", F.expr("bitmap_bit_position(code + 1)").cast("int"))
        seen = self._seen(m)
        if seen is None:
            coded = coded.withColumn("bits", F.lit(None).cast("binary"))
        else:
            coded = coded.join(F.broadcast(seen) if small(seen) else seen, ["shard", "bucket"], "left")
        byte = F.conv(F.hex(F.substring("bits", (F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        unset = F.getbit(F.coalesce(byte, F.lit(0)), F.col("position") % 8) == 0
        put(coded.withColumn("admitted", unset).drop("bits"), "coded")
        schema = T.StructType([*coded.drop("bits").schema.fields, T.StructField("admitted", T.BooleanType())])
        coded = spark.read.schema(schema).parquet(f"{self.path}/{at}/coded")

        # unite: what is new, as deltas
        put(coded.where("new").select("shard", "id", "code"), "dictionary")
        put(coded.where("admitted").groupBy("shard", "bucket").agg(F.expr("bitmap_construct_agg(position)").alias("bits")), "seen")
        top = {r[0]: r[1] for r in coded.where("new").groupBy("shard").agg(F.max("code") + 1).collect()}  # one number per shard
        old = m["next"] or [0] * shards
        out = {"shards": shards, "next": [max(old[s], top.get(s, 0)) for s in range(shards)], "dictionary": [*m["dictionary"], f"{at}/dictionary"], "seen": [*m["seen"], f"{at}/seen"], "token": token, "at": at}
        if len(out["seen"]) > COMPACT_AFTER:
            put(spark.read.schema(DICTIONARY).parquet(*[f"{self.path}/{x}" for x in out["dictionary"]]), "whole/dictionary")
            put(self._seen(out), "whole/seen")
            out |= {"dictionary": [f"{at}/whole/dictionary"], "seen": [f"{at}/whole/seen"]}
        self._commit(base + 1, out)
        return answer(coded)

    def _commit(self, version: int, manifest: dict) -> None:
        """The manifest is written whole beside and takes its name only where none has it yet."""
        p, fs = _fs(self.spark, f"{self.path}/.manifest-{version}-{uuid.uuid4().hex[:8]}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = _fs(self.spark, f"{self.path}/manifest-{version}")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(p), context.makeQualified(target), none)  # fails where the target exists
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                raise StaleLedger(f"version {version} was committed by another batch") from e
            raise

    def seen_count(self) -> int:
        seen = self._seen(self._manifest(self.version()))
        return 0 if seen is None else seen.select(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).first()[0]

    def forget(self) -> None:
        remove(self.spark, self.path)


def channel_messages(cards: DataFrame, pix: DataFrame) -> DataFrame:
    """Both channels in one shape: chave ('channel|id'), canal, id_mensagem, dt_crga, nm_arqv_orgm."""
    shape = lambda df, canal, col: df.select(F.lit(canal).alias("canal"), message_id(F.col(col)).alias("id_mensagem"), "dt_crga", "nm_arqv_orgm")
    both = shape(cards, "crto", "id_unco").unionByName(shape(pix, "pix", "id_unco_pix"))
    return both.withColumn("chave", F.when(F.col("id_mensagem").isNotNull(), F.concat("canal", F.lit("|"), "id_mensagem")))


def admit_batches(spark: SparkSession, messages: DataFrame, batch: Column, id_col: str, order: Sequence[Column], payload: Sequence[str] = ()) -> DataFrame | None:
    """The ledger's answers over batches in order, or None without messages: batch number, then as ``SeenLedger.admit``.

    The messages are written once, divided by batch, so each batch reads its own rows only.
    """
    at = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex[:12]}"
    rows = messages.withColumn("lote", F.coalesce(batch.cast("string"), F.lit("")))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("lote").parquet(at)
    p, fs = _fs(spark, at)
    names = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory())
    ledger = SeenLedger(spark)
    out = None
    # the batch without value comes last
    for i, n in enumerate(sorted(names, key=lambda n: ("HIVE_DEFAULT" in n, n))):
        got = ledger.admit(spark.read.schema(messages.schema).parquet(f"{at}/{n}"), id_col, order, payload).withColumn("batch", F.lit(i))
        out = got if out is None else out.unionByName(got)
    remove(spark, at)
    return out
