"""Review of predicted rules: repairs, locks to the asked rules, lanes of issues and notes, the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.parsing import confidence_of_words, confidence_words, recomputed_result, repaired_status
from sparloom.functions.text import trimmed

RULE = "struct<rule_id:string,value:string,front_visible:string,front_status:string,side_visible:string,side_status:string,back_visible:string,back_status:string,result:string,issue_type:string,confidence:string,reason:string,evidence:array<struct<view:string,note:string>>>"


def repaired(r: Column) -> Column:
    """A rule with repaired statuses and the result that follows from them."""
    fixed = {f"{v}_status": repaired_status(r[f"{v}_status"]) for v in V.VIEWS}
    out = r
    for name, c in fixed.items():
        out = out.withField(name, c)
    return out.withField("issue_type", repaired_status(r["issue_type"])).withField("result", recomputed_result(*fixed.values()))


def normalized(rules: Column) -> Column:
    """Rules (array of RULE) with repaired statuses and the result that follows from them."""
    return F.transform(rules, repaired)


def locked(rules: Column, asked: Column) -> Column:
    """Rules with the ids and values of the asked rules, place by place, if there are as many; else as they are."""
    both = F.zip_with(rules, asked, lambda r, a: r.withField("rule_id", a["rule_id"]).withField("value", a["value"]))
    return F.when(F.size(rules) == F.size(asked), both).otherwise(rules)


def facts(at) -> dict[str, Column]:
    """What lanes are told from, by name, so that each is worked out once a rule: statuses without blanks by view, the
    rule's issue, whether it is wrong or unsure, its confidence as words, its reason and its evidence. ``at`` gives the
    rule's fields by their names."""
    plain = lambda c, other="": trimmed(F.coalesce(c, F.lit(other)))
    return {
        "rule_id": at("rule_id"),
        "value": at("value"),
        **{v: plain(at(f"{v}_status")) for v in V.VIEWS},
        "issue": plain(at("issue_type"), "none"),
        "wrong": plain(at("result")) == "wrong",
        "unsure": F.coalesce(at("result"), F.lit("")) == "unsure",
        "confidence": confidence_words(at("confidence")),
        "reason": plain(at("reason")),
        "evidence": F.coalesce(at("evidence"), F.array().cast("array<struct<view:string,note:string>>")),
    }


def told(rules: Column) -> Column:
    """The facts of each rule."""
    return F.transform(rules, lambda r: F.struct(*[c.alias(n) for n, c in facts(r.__getitem__).items()]))


def places(at) -> Column:
    """Where a rule has an issue or a note, by its facts: array of (lane, view, issue_type), null where there is none:
    by view, and overall for an issue of the rule that no view shows."""
    place = lambda lane, view, issue: F.struct(F.lit(lane).alias("lane"), F.lit(view).alias("view"), issue.alias("issue_type"))
    shown = [F.when(at(v).isin(*V.ACCEPTANCE_ISSUES), place("billable", v, at(v))).when(at(v).isin(*V.DESIGN_ISSUES), place("design", v, at(v))) for v in V.VIEWS]
    some = lambda allowed: at("front").isin(*allowed) | at("side").isin(*allowed) | at("back").isin(*allowed)
    issue, wrong = at("issue"), at("wrong")
    billable = ((issue == "paired box completion") | (issue.isin(*V.ACCEPTANCE_ISSUES) & wrong)) & ~some(V.ACCEPTANCE_ISSUES)
    design = issue.isin(*V.DESIGN_ISSUES) & wrong & ~some(V.DESIGN_ISSUES)
    return F.array(*shown, F.when(billable, place("billable", "overall", issue)).when(design, place("design", "overall", issue)))


def item(at, k: Column) -> list[Column]:
    """(lane, rule_id, value, view, issue_type, action_type, severity, confidence, reason, evidence) of a rule, by its
    facts, at the place ``k``; evidence is that for the view or overall or, without any, the reason."""
    billable = k["lane"] == "billable"
    fit = F.filter(at("evidence"), lambda e: (e["view"] == k["view"]) | (e["view"] == "overall"))
    reason = F.array(F.struct(k["view"].alias("view"), at("reason").alias("note")))
    action = F.when(billable, F.when(k["issue_type"] == "paired box completion", "unspecified").otherwise("description_correction"))
    found = {"lane": k["lane"], "rule_id": at("rule_id"), "value": at("value"), "view": k["view"], "issue_type": k["issue_type"], "action_type": action, "severity": F.when(~billable, F.lit("medium")), "confidence": confidence_of_words(at("confidence")), "reason": at("reason"), "evidence": F.when(F.size(fit) > 0, fit).otherwise(reason)}
    return [c.alias(n) for n, c in found.items()]


def lanes(found: Column) -> Column:
    """The items of all rules, given what is ``told`` of them, as an array."""
    return F.flatten(F.transform(found, lambda f: F.transform(F.array_compact(places(f.__getitem__)), lambda k: F.struct(*item(f.__getitem__, k)))))


def lane_items(df: DataFrame, rules: str = "rules") -> DataFrame:
    """The items that ``review`` finds in the ``normalized`` rules, in rows: ``df`` without its rules, and the columns
    of an item. Rules are taken apart first, so that most is done on plain columns, which Spark compiles."""
    rest = [F.col(c) for c in df.columns if c != rules]
    views = {f"{v}_status": F.col(f"_{v}") for v in V.VIEWS}
    repairs = {f"_{v}": repaired_status(F.col(f"_r.{v}_status")) for v in V.VIEWS}
    r = df.select(*rest, F.explode_outer(rules).alias("_r")).withColumns({**repairs, "_issue": repaired_status(F.col("_r.issue_type"))})
    mended = {**views, "issue_type": F.col("_issue"), "result": recomputed_result(*views.values())}
    found = r.select(*rest, *[c.alias(f"_of_{n}") for n, c in facts(lambda n: mended.get(n, F.col(f"_r.{n}"))).items()])
    at = lambda n: F.col(f"_of_{n}")
    return found.select("*", F.explode(places(at)).alias("_k")).filter("_k is not null").select(*rest, *item(at, F.col("_k")))


def needs_human(found: Column) -> Column:
    """Any rule, by what is ``told`` of it, unsure or of a confidence below 0.6."""
    return F.exists(found, lambda f: f["unsure"] | (confidence_of_words(f["confidence"]) < 0.6))


def decision(n_billable: Column, n_design: Column, human: Column) -> Column:
    return F.when(human & (n_billable == 0), "unsure").when(n_billable > 0, "fail").when(n_design > 0, "minor_issue").otherwise("pass")


def review(df: DataFrame, rules: str = "rules") -> DataFrame:
    """Adds issues, design notes, counts of results, whether a human must look, and the decision."""
    d = df.withColumn("_told", told(F.col(rules))).withColumns({"_l": lanes(F.col("_told")), "human_review_required": needs_human(F.col("_told"))}).drop("_told")
    of = lambda lane: F.filter("_l", lambda x: x["lane"] == lane)
    d = d.withColumns({"billable_issues": of("billable"), "design_notes": of("design")}).drop("_l")
    result = lambda s: F.size(F.filter(rules, lambda r: r["result"] == s))
    return d.withColumns({"total_rules": F.size(rules), **{f"{s}_rules": result(s) for s in ("correct", "wrong", "unsure")}, "overall_decision": decision(F.size("billable_issues"), F.size("design_notes"), F.col("human_review_required"))})


def merged_by_location(df: DataFrame, local: Column, existing: Column, model: Column) -> DataFrame:
    """Adds location: an existing entry, else the id's own, else the model's, else body."""
    return df.withColumn("location", F.coalesce(existing, local, model, F.lit("body")))


def head_rules_only(rules: DataFrame, category: Column, location: Column, head_categories=("head_key_chain", "cake_roll")) -> DataFrame:
    """For categories that show the head only, the rules of the head."""
    return rules.filter(F.when(category.isin(*head_categories), location == "head").otherwise(F.lit(True)))


