"""Empty annotation tables for samples and their rules, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.operators.basics import keep_first


def _blank(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def templates(samples: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """findings: a row a sample; gold and audit: a row a rule of a sample; manifest: a row a sample with the
    number of its rules. Samples: one row of each category and id, the first by ``position`` or ``_row`` if they
    have one."""
    order = next((c for c in ("position", "_row") if c in samples.columns), None)
    s = keep_first(samples, ["category", "sample_id"], [order]) if order else samples.dropDuplicates(["category", "sample_id"])
    r = s.select("sample_id", "category").join(rules.select("sample_id", "rule_id", "value", F.col("value").alias("atomic_value"), F.col("rule_id").alias("rule_key"), "position"), "sample_id")
    n = r.groupBy("sample_id", "category").agg(F.count("*").alias("rule_count"))
    return {
        "findings": _blank(s.select("sample_id", "category"), (*V.FINDING_COLUMNS, *V.FINDING_OPTIONAL)),
        "gold": _blank(r.drop("position"), V.GOLD_COLUMNS),
        "audit": _blank(r.drop("position"), V.AUDIT_COLUMNS),
        "manifest": s.join(n, ["sample_id", "category"], "left").fillna(0, ["rule_count"]),
    }


def prompt(template: str, sample_id: Column, category: Column, rules: Column) -> Column:
    """A prompt with its sample block: id, category and the rules as JSON."""
    block = F.to_json(F.struct(sample_id.alias("sample_id"), category.alias("category"), rules.alias("atomic_rules")))
    return F.concat(F.lit(template.rstrip() + "\n\n"), block)
