"""Workbooks for samples whose output has come, in follow mode: each sample's workbook is written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.sources.workbooks import to_workbooks
from sparloom.streaming.keyed import KeyedTable


def sync_workbooks(rules: DataFrame, path: str, columns: list[str], keys: list[str] | None = None, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch consumer of finished outputs (``keys``, by default category and sample_id): a workbook of the
    rules of each sample that has rules and no workbook yet, as rows (keys, content) of one folder a batch. A
    batch that comes again replaces its own folder; samples without rules wait for a later batch."""
    keys = keys or ["category", "sample_id"]
    state = KeyedTable(f"{path.rstrip('/')}_written", keys, "number")

    def consume(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, batch.select(*keys).distinct()
        told = done.withColumn("number", F.lit(number))
        done = done.join(state.read(spark, told.schema, number, done), keys, "left_anti")
        wanted = rules.join(done, keys, "left_semi")
        to_workbooks(wanted, keys, columns, order or ["position"]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        state.put(spark.read.parquet(f"{path}/batch={number}").select(*keys).distinct().withColumn("number", F.lit(number)), number)

    return consume


def workbooks(spark, path: str) -> DataFrame:
    """(keys, content, n_bytes) of all workbooks written so far."""
    return spark.read.parquet(path).drop("batch").withColumn("n_bytes", F.length("content"))
