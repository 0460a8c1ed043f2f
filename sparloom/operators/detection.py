"""Verdicts on elements: colour verdicts that are downgraded, counts, and detection of planted changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.colors import color_families, tolerated
from sparloom.functions.text import let, stripped


def downgraded(elements: DataFrame) -> DataFrame:
    """Elements (sample_id, element_id, position, name, expected_value, verdict, issue_type, reason, evidence) with
    verdict and issue_type after the colour rule, and a struct of what was there before where it applied.
    Colours come from reason and evidence; if these name fewer than two, from all texts. Only verdicts that the rule
    may change are searched for colours."""
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat_ws(" ", t("reason"), t("evidence"))
    asked = (F.lower(stripped(t("verdict"))) == "wrong") & (F.lower(stripped(t("issue_type"))) == "color")
    shades = let(color_families(said), lambda f: F.when(F.size(f) < 2, color_families(F.concat_ws(" ", t("name"), t("expected_value"), said))).otherwise(f))
    d = elements.withColumn("_s", F.when(asked, shades))
    d = d.withColumn("_down", F.coalesce(let(F.col("_s"), tolerated), F.lit(False)))
    note = F.struct(F.lit(True).alias("color_family_downgraded"), F.lit(V.COLOR_RULE).alias("rule"), F.col("_s").alias("matched_color_families"), F.col("verdict").alias("original_verdict"), F.col("issue_type").alias("original_issue_type"))
    return d.withColumn("postprocess", F.when(F.col("_down"), note)).withColumns({"verdict": F.when(F.col("_down"), "correct").otherwise(F.col("verdict")), "issue_type": F.when(~F.col("_down"), F.col("issue_type"))}).drop("_s", "_down")


def verdict_counts(elements: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = [F.count("*").alias("elements"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "wrong", "uncertain")]]
    return elements.groupBy(*by).agg(*counts) if by else elements.agg(*counts)


def issue_counts(elements: DataFrame) -> DataFrame:
    """Wrong elements by issue; without one, null as text."""
    issue = F.coalesce(F.nullif(F.col("issue_type"), F.lit("")), F.lit("null"))
    wrong = F.count_if(F.col("verdict") == "wrong")  # counted, not filtered: a filter would be worked out apart from the columns
    return elements.groupBy(issue.alias("issue_type")).agg(wrong.alias("n")).filter("n > 0").orderBy("issue_type")


def target_id(sample: Column, index: Column) -> Column:
    return F.format_string("%s_e%03d", sample, index.cast("int"))


def detection(elements: DataFrame, mutations: DataFrame) -> DataFrame:
    """One row a mutation (negative_sample_id, mutated_element_index, expected_issue_type): whether the target was
    found, caught and named rightly, and how many other elements of its sample were called wrong. A mutation
    whose target is missing counts no others."""
    first = F.min_by(F.struct("position", "verdict", "issue_type"), "position").alias("r")
    mine = elements.groupBy("sample_id", "element_id").agg(first, F.count_if(F.col("verdict") == "wrong").alias("_own"))
    wrong = mine.groupBy("sample_id").agg(F.sum("_own").alias("_wrong"))
    mine = mine.select("sample_id", "element_id", "r.*", "_own")
    m = mutations.select(F.col("negative_sample_id").alias("sample_id"), target_id(F.col("negative_sample_id"), F.col("mutated_element_index")).alias("element_id"), "expected_issue_type")
    d = m.join(mine, ["sample_id", "element_id"], "left").join(wrong, "sample_id", "left")
    found = F.col("position").isNotNull()
    caught = found & F.coalesce(F.col("verdict") == "wrong", F.lit(False))
    named = caught & F.coalesce(F.col("issue_type") == F.col("expected_issue_type"), F.lit(False))
    return d.select("sample_id", "element_id", "expected_issue_type", "verdict", "issue_type", found.alias("found"), caught.alias("caught"), named.alias("issue_matched"), F.when(found, F.col("_wrong") - F.col("_own")).otherwise(0).alias("extra_wrong"))


def detection_summary(rows: DataFrame) -> DataFrame:
    """Totals over mutations; other wrong elements count once a mutation."""
    return rows.agg(F.count("*").alias("target_total"), F.count_if("caught").alias("target_caught"), F.count_if("issue_matched").alias("issue_matched"), F.count_if(~F.col("caught")).alias("missed"), F.count_if(F.col("caught") & ~F.col("issue_matched")).alias("issue_mismatches"), F.coalesce(F.sum("extra_wrong"), F.lit(0)).alias("extra_wrong_count"))


def caught_by_issue(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected_issue_type").agg(F.count("*").alias("total"), F.count_if("caught").alias("caught")).orderBy("expected_issue_type")
