"""Annotation products out of a folder of workbooks: annotations, checks, a summary and inputs by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.operators.quality import check_legacy, check_views, sample_summary
from sparloom.sources import workbooks as W

COLUMNS = tuple(dict.fromkeys((*V.GOLD_COLUMNS, *V.VIEWS, "issue_type", "confidence", "reason")))
FILLED = {"v3_visible_status": V.GOLD_COLUMNS[3:], "legacy_front_side_back_bool": (*V.VIEWS, "result", "reason")}


def build(spark: SparkSession, root: str, rules: DataFrame | None = None, include_empty: bool = False) -> dict[str, DataFrame]:
    """Sheets <category>/<sample>/*.xlsx below ``root``."""
    return merge(W.read_cells(spark, root), rules, include_empty)


def merge(cells: DataFrame, rules: DataFrame | None = None, include_empty: bool = False) -> dict[str, DataFrame]:
    """Products of sheets that are read cell by cell (path, source_row, cells). Rows without sample and rule are left
    out; so are sheets without any annotation unless ``include_empty``."""
    part = lambda k: F.try_element_at(F.split("path", "/"), F.lit(k))
    table = W.as_table(W.records(cells), COLUMNS).withColumn("schema_version", W.view_schema(F.col("header"))).filter("schema_version is not null")
    table = table.withColumn("category", part(-3)).filter("sample_id <> '' or rule_id <> ''").withColumn("_row", F.col("source_row").cast("long"))
    some = lambda s: F.greatest(*[F.col(c) != "" for c in FILLED[s]])
    filled = F.when(F.col("schema_version") == "v3_visible_status", some("v3_visible_status")).otherwise(some("legacy_front_side_back_bool"))
    if not include_empty:
        used = table.groupBy("path").agg(F.bool_or(filled).alias("_used")).filter("_used").select("path")
        table = table.join(used, "path", "left_semi")
    report = check_views(table.filter("schema_version = 'v3_visible_status'"), rules).unionByName(check_legacy(table.filter("schema_version <> 'v3_visible_status'"), rules))
    inputs = table.groupBy("category", "sample_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("source_row", *[F.col(c) for c in V.GOLD_COLUMNS[1:]])))).alias("rules"))
    return {"annotations": table.drop("header"), "report": report.drop("header"), "summary": sample_summary(table, report), "agent_inputs": inputs}
