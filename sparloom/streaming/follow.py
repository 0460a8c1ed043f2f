"""Follow mode: files that appear are consumed once each, in micro-batches, with a checkpoint to resume from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparloom.operators.basics import keep_first
from sparloom.operators.queue import partition
from sparloom.streaming.keyed import FAN, KeyedTable


def follow(spark: SparkSession, path: str, schema: str, checkpoint: str, consume: Callable[[DataFrame, int], None], fmt: str = "json", until_done: bool = True, per_batch: int = 100) -> StreamingQuery:
    """Calls ``consume(batch, number)`` for new files below ``path``. ``until_done``: stop when none are left,
    else keep following. A batch may come again after a failure, so ``consume`` should be repeatable by number."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(path)
    out = source.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if until_done else out.trigger(processingTime="5 seconds")).start()


def append_new(path: str, key: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A consumer that keeps one row of each key, of a batch the first by ``order`` if given: those already written,
    also by an earlier try of the same batch, are left out."""

    def consume(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fresh = keep_first(batch, [key], [order]) if order else batch.dropDuplicates([key])
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            done = spark.read.schema(batch.schema).parquet(path).select(key)
            fresh = fresh.join(done, key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return consume


def snapshot(path: str, key: str, order: str, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """A consumer that keeps the latest row of each key. A batch writes what it brings, and now and then merges
    what earlier ones wrote."""
    return KeyedTable(path, [key], order, fan).put


def read_snapshot(spark: SparkSession, path: str, key: str, order: str, schema: StructType, batches: int | None = None, fan: int = FAN) -> DataFrame:
    """The latest row of each key after so many batches, or all."""
    table = KeyedTable(path, [key], order, fan)
    return table.read(spark, schema, table.batches(spark) if batches is None else batches)


def queue_states(samples: DataFrame, outputs: DataFrame, attempted: DataFrame, rules: DataFrame, errors: DataFrame) -> DataFrame:
    """States of the queue at this moment; following ends when none is waiting or ready."""
    return partition(samples, outputs, attempted, rules, errors)


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream of the first row of each key; state of keys older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
