"""Row-level rules for annotation tables: issues and warnings in a fixed order, PASS, WARN or FAIL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom import vocabulary as V

Codes = list[tuple[Column, Column]]


def code(condition: Column, text: str, value: Column | None = None) -> tuple[Column, Column]:
    return F.coalesce(condition, F.lit(False)), F.lit(text) if value is None else F.concat(F.lit(text), value)


def listed(codes: Codes) -> Column:
    return F.array_compact(F.array(*[F.when(c, t) for c, t in codes])) if codes else F.array().cast("array<string>")


def joined(codes: Codes) -> Column:
    """Semicolon list of the codes whose condition holds."""
    return F.array_join(listed(codes), ";")


def told(df: DataFrame, issues: list[Column], warnings: list[Column]) -> DataFrame:
    """``df`` with qc_status, issues and warnings out of semicolon lists, in their order; a blank one says nothing.

    What a row tells by itself is put together before it is joined and sorted, so that only its lists travel."""
    line = lambda parts: F.concat_ws(";", *[F.nullif(p, F.lit("")) for p in parts])
    out = df.withColumns({"issues": line(issues), "warnings": line(warnings)})
    return out.withColumn("qc_status", F.when(F.col("issues") != "", "FAIL").when(F.col("warnings") != "", "WARN").otherwise("PASS"))


def judged(df: DataFrame, issues: Codes, warnings: Codes) -> DataFrame:
    """``df`` with qc_status, issues and warnings (semicolon lists)."""
    out = df.withColumns({"_i": listed(issues), "_w": listed(warnings)})
    return out.withColumns({"qc_status": status(F.size("_i"), F.size("_w")), "issues": F.array_join("_i", ";"), "warnings": F.array_join("_w", ";")}).drop("_i", "_w")


def status(issues: Column, warnings: Column) -> Column:
    return F.when(issues > 0, "FAIL").when(warnings > 0, "WARN").otherwise("PASS")


def missing_columns(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")


def _missing(df: DataFrame, columns) -> Codes:
    return [code(_text(df, c) == "", f"missing_{c}") for c in columns]


def _outside(df: DataFrame, c: str, allowed, blank_ok: bool) -> tuple[Column, Column]:
    v = _text(df, c)
    return code(~v.isin(*allowed) & (F.lit(True) if not blank_ok else v != ""), f"invalid_{c}:", v)


def _repeat(df: DataFrame, keys: list[str], text: str) -> tuple[Column, Column]:
    return code(F.row_number().over(Window.partitionBy(*[_text(df, k) for k in keys]).orderBy("_row")) > 1, text)


def _with_samples(df: DataFrame, samples: DataFrame | None) -> DataFrame:
    """Registry columns _sample (known) and _category; without a registry nothing is unknown."""
    if samples is None:
        return df.withColumns({"_sample": F.lit(True), "_category": F.lit("")})
    known = samples.select("sample_id", F.lit(True).alias("_sample"), F.col("category").alias("_category")).dropDuplicates(["sample_id"])
    return df.join(known, "sample_id", "left").withColumn("_sample", F.coalesce("_sample", F.lit(False)) | (F.col("sample_id") == ""))


def _with_rules(df: DataFrame, samples: DataFrame | None, rules: DataFrame | None) -> DataFrame:
    """Registry columns _sample, _has_rules (the sample has any), _known (this rule) and _value (its value)."""
    df = _with_samples(df, samples)
    if rules is None:
        return df.withColumns({"_has_rules": F.lit(False), "_known": F.lit(False), "_value": F.lit(None).cast("string")})
    some = rules.select("sample_id", F.lit(True).alias("_has_rules")).distinct()
    values = rules.groupBy("sample_id", "rule_id").agg(F.max("value").alias("_value"), F.lit(True).alias("_known"))
    return df.join(some, "sample_id", "left").join(values, ["sample_id", "rule_id"], "left").fillna(False, ["_has_rules", "_known"])


def _file_level(df: DataFrame, missing: list[str]) -> DataFrame:
    issues = ";".join(f"missing_column:{c}" for c in missing)
    return df.sparkSession.createDataFrame([(0, "FAIL", issues, "")], "row_number long, qc_status string, issues string, warnings string")


def _report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Report rows with the number of the line (the header is line 1)."""
    return df.select((F.row_number().over(Window.partitionBy("_file").orderBy("_row")) + 1).cast("long").alias("row_number") if "_file" in df.columns else (F.col("_row") + 2).alias("row_number"), *[F.col(k) for k in keys if k in df.columns], "qc_status", "issues", "warnings")


def check_findings(df: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Report of visual findings."""
    if missing := missing_columns(df, V.FINDING_COLUMNS):
        return _file_level(df, missing)
    unnamed = (_text(df, "feature_key") == "") & (_text(df, "human_rule_name") == "") & (_text(df, "element_name") == "")
    filled = [*_missing(df, V.FINDING_COLUMNS), code(unnamed, "missing_feature_key_or_human_rule_name_or_element_name")]
    values = [
        _outside(df, "view", V.VIEW_VALUES, True),
        _outside(df, "issue_type", V.ISSUE_TYPES, True),
        _outside(df, "severity", V.SEVERITIES, False),
        _outside(df, "visible", V.OPTIONAL_VISIBLE, False),
        _outside(df, "match_status", V.MATCH_STATUSES, False),
    ]
    d = _with_samples(df.withColumns({"_filled": joined(filled), "_values": joined(values)}), samples)
    category = _text(d, "category")
    repeat = _repeat(d, ["sample_id", "finding_id"], "duplicate_finding_id_for_sample")
    differs = code((category != "") & (F.col("_category") != "") & (category != F.col("_category")), "category_mismatch_expected_", F.col("_category"))
    issues = [F.col("_filled"), joined([code(~F.col("_sample"), "unknown_sample_id")]), F.col("_values"), joined([repeat])]
    return _report(told(d, issues, [joined([differs])]), ["_file", "sample_id", "category", "finding_id"])


def view_codes(df: DataFrame, visible_statuses=V.STATUS_IF_VISIBLE, errors=V.ERROR_STATUSES, results=V.RESULTS, unsure_ok: bool = False) -> Codes:
    """Codes of the three views' visibility and status, and of the result that follows from them."""
    out: Codes = []
    wrong = F.lit(False)
    for v in V.VIEWS:
        visible, s = _text(df, f"{v}_visible"), _text(df, f"{v}_status")
        out += [code((visible != "") & ~visible.isin(*V.VISIBLE), f"invalid_{v}_visible:", visible), code((visible == "visible") & (s != "") & ~s.isin(*visible_statuses), f"invalid_{v}_status_for_visible:", s), code((visible == "invisible") & (s != "") & ~s.isin(*V.STATUS_IF_INVISIBLE), f"invalid_{v}_status_for_invisible:", s)]
        wrong = wrong | s.isin(*errors)
    result, expected = _text(df, "result"), F.when(wrong, "wrong").otherwise("correct")
    known = result.isin(*results)
    out += [code((result != "") & ~known, "invalid_result:", result), code((result != "") & known & (result != expected) & ((result != "unsure") | F.lit(not unsure_ok)), "result_mismatch_expected_", expected)]
    return out


def _rule_codes(df: DataFrame) -> tuple[Codes, Codes]:
    asked = (_text(df, "sample_id") != "") & (_text(df, "rule_id") != "")
    issues = [code(asked & ~F.col("_sample"), "unknown_sample_id"), code(asked & F.col("_sample") & F.col("_has_rules") & ~F.col("_known"), "rule_id_not_in_atomic_rules")]
    value = _text(df, "atomic_value")
    return issues, [code(asked & F.col("_sample") & F.col("_known") & (value != "") & (value != F.col("_value")), "atomic_value_differs_from_source")]


def check_gold(df: DataFrame, samples: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Report of annotated rules with visibility and status by view."""
    if missing := missing_columns(df, V.GOLD_COLUMNS):
        return _file_level(df, missing)
    d = _with_rules(df.withColumns({"_filled": joined(_missing(df, V.GOLD_COLUMNS)), "_values": joined(view_codes(df))}), samples, rules)
    known, differs = _rule_codes(d)
    repeat = _repeat(d, ["sample_id", "rule_id"], "duplicate_rule_id_for_sample")
    return _report(told(d, [F.col("_filled"), joined(known), F.col("_values"), joined([repeat])], [joined(differs)]), ["_file", "sample_id", "category", "rule_id"])


def check_audit(df: DataFrame, samples: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Report of the audit of rules."""
    if missing := missing_columns(df, V.AUDIT_COLUMNS):
        return _file_level(df, missing)
    validity = _text(df, "rule_validity")
    filled = _missing(df, ("sample_id", "category", "rule_id", "atomic_value", "rule_validity"))
    values = [_outside(df, "rule_validity", V.RULE_VALIDITIES, True), code((validity == "wrong_value") & (_text(df, "corrected_value") == ""), "missing_corrected_value_for_wrong_value")]
    reason = code((validity != "") & (validity != "correct") & (_text(df, "reason") == ""), "non_correct_without_reason")
    d = _with_rules(df.withColumns({"_filled": joined(filled), "_values": joined(values), "_reason": joined([reason])}), samples, rules)
    known, differs = _rule_codes(d)
    repeat = _repeat(d, ["sample_id", "rule_id"], "duplicate_rule_id_for_sample")
    return _report(told(d, [F.col("_filled"), joined(known), F.col("_values"), joined([repeat])], [joined(differs), F.col("_reason")]), ["_file", "sample_id", "category", "rule_id"])


def check_legacy(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Report of the older sheets with TRUE or FALSE by view; ``rules``: known (sample_id, rule_id)."""
    outside = [code((_text(df, c) != "") & ~_text(df, c).isin("TRUE", "FALSE"), f"invalid_{c}:", _text(df, c)) for c in V.VIEWS]
    result = _text(df, "result")
    values = [*_missing(df, ("sample_id", "rule_id", "value", *V.VIEWS, "result")), *outside, code((result != "") & ~result.isin(*V.RESULTS), "invalid_result:", result)]
    reason = code((result == "wrong") & (_text(df, "reason") == ""), "wrong_without_reason")
    d = _with_rules(df.withColumns({"_values": joined(values), "_reason": joined([reason])}), None, rules)
    unknown = code(F.col("_has_rules") & ~F.col("_known"), "rule_id_not_in_atomic_rules")
    return told(d, [F.col("_values")], [F.col("_reason"), joined([unknown])]).drop("_values", "_reason", "_sample", "_category", "_has_rules", "_known", "_value")


def check_views(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Like check_gold for sheets that are merged into products: unknown rules only warn."""
    d = _with_rules(df, None, rules)
    out = judged(d, [*_missing(d, V.GOLD_COLUMNS), *view_codes(d)], [code(F.col("_has_rules") & ~F.col("_known"), "rule_id_not_in_atomic_rules")])
    return out.drop("_sample", "_category", "_has_rules", "_known", "_value")


def check_predictions(rules: DataFrame, expected: DataFrame) -> DataFrame:
    """(sample_id, rule_id, value, qc_status, issues, warnings) of predicted rules against the expected
    (sample_id, rule_id): rules that were not asked for warn, those that did not come back fail."""
    want = expected.select("sample_id", "rule_id", F.lit(True).alias("_want")).distinct()
    d = rules.join(want, ["sample_id", "rule_id"], "left")
    issues = [*_missing(d, V.GOLD_COLUMNS[1:]), *view_codes(d, V.REVIEW_STATUS_IF_VISIBLE, V.REVIEW_ERROR_STATUSES, (*V.RESULTS, "unsure"), True)]
    back = judged(d, issues, [code(F.col("_want").isNull(), "rule_id_not_in_expected_set")]).select("sample_id", "rule_id", "value", "qc_status", "issues", "warnings")
    lost = want.join(rules, ["sample_id", "rule_id"], "left_anti").select("sample_id", "rule_id", F.lit("").alias("value"), F.lit("FAIL").alias("qc_status"), F.lit("missing_from_output").alias("issues"), F.lit("").alias("warnings"))
    return back.unionByName(lost)


def fail_on_errors(report: DataFrame) -> None:
    """An error if any row of the report failed."""
    if n := report.filter("qc_status = 'FAIL'").count():
        raise ValueError(f"{n} rows failed")


def passed(report: DataFrame) -> DataFrame:
    """The rows of a report of which none may have failed: the same gate inside a plan, where a failed row is an error."""
    told = F.concat(F.lit("a row failed: "), F.col("issues"))
    return report.filter(F.when(F.col("qc_status") != "FAIL", F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def sample_summary(annotations: DataFrame, report: DataFrame) -> DataFrame:
    """Per category and sample: rules, results, outcomes of the check, and the first schema version."""
    a = annotations.groupBy("category", "sample_id").agg(F.count("*").alias("rule_rows"), F.count_if(F.col("result") == "correct").alias("correct_rows"), F.count_if(F.col("result") == "wrong").alias("wrong_rows"), F.min_by("schema_version", "_row").alias("schema_version"))
    q = report.groupBy("category", "sample_id").agg(*[F.count_if(F.col("qc_status") == s).alias(f"qc_{s.lower()}_rows") for s in ("PASS", "WARN", "FAIL")])
    return a.join(q, ["category", "sample_id"], "left").fillna(0, ["qc_pass_rows", "qc_warn_rows", "qc_fail_rows"])
