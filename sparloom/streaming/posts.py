"""Acceptance of posts from a stream: a post is kept unless one kept before it has its id or signature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.operators.curation import accept_first, cascade
from sparloom.operators.shared import materialize
from sparloom.streaming.keyed import FAN, KeyedTable

KEYS = ["id", "signature"]


def _keys_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(kind, value, first): every key that is not blank, with the row's order."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])
    return rows.select(F.inline(each), F.col(order).cast("long").alias("first")).filter("value <> ''")


def accept_posts(path: str, order: str = "order", on_accept: Callable[[DataFrame, int], None] | None = None, existing: DataFrame | None = None, keys: list[str] | None = None, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """A foreachBatch consumer: the gates, then keep-first within the batch and against all that was kept before:
    ``existing`` rows, and those of earlier batches (one folder a batch, so a repeated batch replaces itself).

    The gates are applied once, by all tasks however few files a batch has, and what they say is written: the many steps
    after them read it. The keys of kept posts are state by key, beside ``path``: a batch asks for its own keys only, so its time does
    not grow with what has been kept. ``keys``: what must not repeat, by default id and signature."""
    keys, state = keys or KEYS, KeyedTable(f"{path.rstrip('/')}_seen", ["kind", "value"], "first", fan)

    def consume(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        gated = materialize(cascade(batch.repartition(spark.sparkContext.defaultParallelism, order)), "gated").filter("accepted")
        asked = _keys_of(gated, keys, order)
        if number == 0:
            state.put(_keys_of(existing, keys, order) if existing is not None else asked.limit(0), 0)
        seen = state.read(spark, asked.schema, number + 1, asked)
        seen = seen.select(*[F.when(F.col("kind") == k, F.col("value")).alias(k) for k in keys])
        kept = accept_first(gated, order, keys, seen).filter("kept").drop("kept")
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept = spark.read.schema(gated.schema).parquet(f"{path}/batch={number}")
        state.put(_keys_of(kept, keys, order), number + 1)
        if on_accept is not None:
            on_accept(kept, number)

    return consume
