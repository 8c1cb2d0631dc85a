"""Raw records as a stream: each micro-batch is validated and split, and each record is stored once, however often it comes again.

What has been stored is state of the stream, one entry a key in the RocksDB state store under the query's checkpoint: a batch looks up
and writes only the keys that it holds, so what it reads doesn't grow with what is stored. A batch's rows go to a folder
of that batch's number, which a batch that is run again replaces.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from ..store import Folder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Validated rows (column `reason`) that hold something new, once: of accepted ones each key, of rejected ones each content; the first in `order` of a batch.

    `seen` is a batch's own time, which a repeated batch keeps: a key whose first and last sighting are one and the same batch is new.
    """
    rest = [c for c in stream.columns]
    content = F.sha2(F.to_json(F.struct(*rest)), 256)
    d = stream.withColumn("__key", F.when(F.col("reason").isNull(), F.concat(F.lit("+"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("-"), content)))
    d = d.filter(F.col("__key").isNotNull()).withColumn("__seen", F.current_timestamp())
    first = F.min_by(F.struct("__seen", *rest), F.struct("__seen", order))
    per = d.groupBy("__key").agg(first.alias("__first"), F.max("__seen").alias("__last"))
    return per.filter(F.col("__first.__seen") == F.col("__last")).select(*[F.col(f"__first.{c}").alias(c) for c in rest])


def run(stream: DataFrame, checkpoint: str, accepted: str, rejected: str | None, key: str, order: str) -> list[dict]:
    """Works on all that is available, in micro-batches, and ends; gives the progress reports of the batches.

    Accepted rows go to `accepted` without the reason, rejected ones to `rejected` if that is given; a null key is not stored. Under a new
    checkpoint the tables may hold what other checkpoints stored, which no state knows: then batches are also held against those.
    """
    spark = stream.sparkSession
    new = first_seen(stream if rejected else stream.filter("reason is null"), key, order)
    mine = query_id(spark, checkpoint)
    others = {path: [f"{path}/{x}" for x in Folder(spark, path).names(path) if "-" in x and not x.startswith((mine, "_", "."))] for path in (accepted, rejected) if path}

    def put(d: DataFrame, path: str, number: int, known: list[str]) -> None:
        if others[path]:
            at = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in known]
            old = spark.read.schema(d.schema).parquet(*others[path])
            d = d.withColumn("__k", F.array(*at)).join(old.select(F.array(*at).alias("__k")).distinct(), "__k", "left_anti").drop("__k")
        made = f"{path}/_batch-{number}"
        d.write.mode("overwrite").parquet(made)
        folder = Folder(spark, path)
        writers.placed(folder, made, path, f"{mine}-{number}")
        folder.delete(made)

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            put(batch.filter("reason is null").drop("reason"), accepted, number, [key])
            if rejected:
                put(batch.filter("reason is not null"), rejected, number, batch.columns)
        finally:
            batch.unpersist()

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        q = new.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    try:
        q.processAllAvailable()
        # A batch is reported, to listeners too, after it counts as done.
        for _ in range(200):
            if not q.status["isTriggerActive"]:
                break
            time.sleep(0.05)
        return [json.loads(p.json) for p in q.recentProgress]
    finally:
        q.stop()


def query_id(spark, checkpoint: str) -> str:
    """A name for what is stored under a checkpoint, kept beside it: the same whenever it is resumed."""
    folder, path = Folder(spark, checkpoint), f"{checkpoint.rstrip('/')}-name"
    if not folder.names(path):
        folder.make(f"{path}/{uuid.uuid4().hex[:12]}")
    return folder.names(path)[0]


def distinct_keys(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """For keys that repeat within bounded time: state is dropped behind the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), F.coalesce("reason", F.lit("accepted")).alias("outcome")).count()
