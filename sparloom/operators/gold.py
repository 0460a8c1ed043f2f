"""Audited gold: promotion of annotated rules, exclusions, coverage gaps, what is still blocked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.text import first_filled
from sparloom.operators.basics import keep_first


def promote(gold: DataFrame, audit: DataFrame, allow_unaudited: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verified, excluded). Gold joins the first audit row of its sample and rule; validity correct promotes;
    other validities, blank ones and missing audits exclude, with their reason. Catalyst picks the join."""
    index = keep_first(audit.filter("sample_id <> '' and rule_id <> ''"), ["sample_id", "rule_id"], ["_row"])
    a = index.select("sample_id", "rule_id", *[F.coalesce(F.col(c), F.lit("")).alias(f"a_{c}") for c in ("category", "atomic_value", "rule_validity", "reason")], F.lit(True).alias("audited"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in gold.columns else F.lit("")
    joined = gold.join(a, ["sample_id", "rule_id"], "left")
    plain = [text(c).alias(c) for c in V.VERIFIED_COLUMNS[4:14]]
    audited = F.coalesce("audited", F.lit(False))
    validity = F.when(audited, F.col("a_rule_validity")).otherwise(F.lit("unaudited" if allow_unaudited else ""))
    reason = F.when(~audited, F.lit(None if allow_unaudited else "missing_audit")).when(F.col("a_rule_validity") == "correct", F.lit(None)).otherwise(F.concat(F.lit("rule_validity_"), first_filled(F.col("a_rule_validity"), F.lit("blank"))))
    rows = joined.select(text("sample_id").alias("sample_id"), first_filled(text("category"), F.col("a_category")).alias("category"), text("rule_id").alias("rule_id"), first_filled(text("value"), F.col("a_atomic_value")).alias("value"), *plain, validity.alias("audit_rule_validity"), F.coalesce("a_reason", F.lit("")).alias("audit_reason"), reason.alias("exclude_reason"))
    return rows.filter("exclude_reason is null").drop("exclude_reason"), rows.filter("exclude_reason is not null")


def coverage_gaps(findings: DataFrame, audit: DataFrame) -> DataFrame:
    """Every finding with whether its sample has audited rules."""
    audited = audit.select("sample_id").distinct().withColumn("_seen", F.lit(True))
    columns = ("category", "finding_id", "view", "issue_type", "feature_key", "expected_from_2d", "observed_in_multiview", "severity")
    return findings.join(audited, "sample_id", "left").select("sample_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in findings.columns else F.lit("").alias(c) for c in columns], F.when(F.col("_seen"), "needs_rule_mapping").otherwise("sample_not_in_rule_audit").alias("gap_reason"))


def rule_quality(audit: DataFrame) -> DataFrame:
    return audit.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in audit.columns else F.lit("").alias(c) for c in V.RULE_QUALITY_COLUMNS])


def blocked_steps(findings: DataFrame, audit: DataFrame, verified: DataFrame, quota_blocked: bool = False) -> list[tuple[str, str]]:
    """Steps that cannot run yet, and what they wait for."""
    steps = [
        (findings.isEmpty(), "final coverage/generation quality metrics", "human_visual_findings not received"),
        (audit.isEmpty(), "atomic rule quality metrics", "atomic_rule_audit not received"),
        (verified.isEmpty(), "prediction accuracy against verified gold", "verified_evaluation_gold not built"),
        (quota_blocked, "expanded baseline prediction", "API quota unavailable"),
    ]
    return [(step, why) for blocked, step, why in steps if blocked]
