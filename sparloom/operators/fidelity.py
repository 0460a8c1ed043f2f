"""Fidelity score of assessment records: elements 60, specification 20, identity 15, quality 5, less penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.parsing import bounded
from sparloom.functions.text import stripped

RECORD = "sample_id string, element_assessments array<struct<name:string,weight:double,status:string,evidence:string>>, spec_checks map<string,boolean>, identity_match double, visual_quality double, hallucinations array<struct<description:string,severity:string>>"


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def problem(d: DataFrame) -> Column:
    """What makes a record invalid, or null."""
    a, h = F.col("element_assessments"), F.coalesce("hallucinations", F.array().cast("array<struct<description:string,severity:string>>"))
    blank = lambda c: stripped(F.coalesce(c, F.lit(""))) == ""
    bad = lambda e: blank(e["name"]) | blank(e["evidence"]) | ~F.coalesce(e["status"].isin(*V.ELEMENT_FACTORS), F.lit(False)) | (F.coalesce(e["weight"], F.lit(1.0)) <= 0)
    specs = F.array(*[F.try_element_at("spec_checks", F.lit(k)) for k in V.SPEC_POINTS])
    return (
        F.when(blank(F.col("sample_id")), "sample_id must be filled")
        .when(F.coalesce(F.size(a), F.lit(0)) <= 0, "element_assessments must be filled")
        .when(F.exists(a, bad), "an element assessment is invalid")
        .when(F.forall(a, lambda e: e["status"] == "unverifiable"), "all elements are unverifiable")
        .when(F.col("spec_checks").isNull() | F.exists(specs, lambda s: s.isNull()), "a specification check is missing")
        .when(F.exists(h, lambda x: blank(x["description"]) | ~F.coalesce(x["severity"].isin(*V.HALLUCINATION_PENALTIES), F.lit(False))), "a hallucination is invalid")
    )


def scored(records: DataFrame) -> DataFrame:
    """Records with their points, total, critical reasons, label and whether a human must look. An invalid
    record is an error."""
    ok = F.when(problem(records).isNotNull(), F.raise_error(F.concat_ws(": ", "sample_id", problem(records))).cast("boolean")).otherwise(F.lit(True))
    d = records.filter(ok)
    factor = lambda e: F.coalesce(*[F.when(e["status"] == s, F.lit(f)) for s, f in V.ELEMENT_FACTORS.items() if f is not None])
    weight = lambda e: F.coalesce(e["weight"], F.lit(1.0))
    sure = F.filter("element_assessments", lambda e: e["status"] != "unverifiable")
    elements = 60.0 * _sum(F.transform(sure, lambda e: weight(e) * factor(e))) / _sum(F.transform(sure, weight))
    has = lambda k: F.element_at("spec_checks", F.lit(k))
    spec = sum((F.when(has(k), p).otherwise(0.0) for k, p in V.SPEC_POINTS.items()), F.lit(0.0))
    wrongs = F.coalesce("hallucinations", F.array().cast("array<struct<description:string,severity:string>>"))
    penalty = _sum(F.transform(wrongs, lambda x: F.coalesce(*[F.when(x["severity"] == s, F.lit(p)) for s, p in V.HALLUCINATION_PENALTIES.items()])))
    identity, quality = bounded(F.col("identity_match"), "identity_match"), bounded(F.col("visual_quality"), "visual_quality")
    reasons = [F.when(~has(k), f"failed_{k}") for k in V.CRITICAL_SPECS] + [F.when(identity < 0.5, "identity_below_0.5"), F.when(F.exists(wrongs, lambda x: x["severity"] == "critical"), "critical_hallucination")]
    d = d.withColumns({"element_points": elements, "spec_points": spec, "identity_points": 15.0 * identity, "quality_points": 5.0 * quality, "penalty": penalty, "critical_reasons": F.array_sort(F.array_compact(F.array(*reasons))), "_open": F.exists("element_assessments", lambda e: e["status"] == "unverifiable")})
    d = d.withColumn("total", F.greatest(F.lit(0.0), F.col("element_points") + F.col("spec_points") + F.col("identity_points") + F.col("quality_points") - F.col("penalty")))
    critical = F.size("critical_reasons") > 0
    label = F.when(critical | (F.col("total") < 70), "fail").when((F.col("total") < 85) | F.col("_open"), "review").otherwise("pass")
    return d.withColumn("label", label).withColumn("requires_human_review", (F.col("label") == "review") | F.col("_open") | critical).drop("_open")
