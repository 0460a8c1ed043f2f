import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.operators import alignment, assignment, audit, basics, coverage, curation, detection, duplicates, events, fidelity, gold, lanes, quality, queue, scoring, templates
from sparloom.plans import extraction, gold_pipeline

TEXT = lambda *c: ", ".join(f"{x} string" for x in c)


def rows_of(spark, rows, columns, row=True):
    data = [tuple(r) + ((i,) if row else ()) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, TEXT(*columns) + (", _row long" if row else ""))


GOOD = ("s1", "r1", "red", "visible", "correct", "visible", "correct", "visible", "correct", "correct")


@pytest.mark.parametrize("change, issues", [
    ({}, ""),
    ({"result": "wrong"}, "result_mismatch_expected_correct"),
    ({"front_status": "wrong color"}, "result_mismatch_expected_wrong"),
    ({"front_status": "wrong color", "result": "wrong"}, ""),
    ({"front_status": "wrong_prosition", "result": "wrong"}, ""),
    ({"back_visible": "invisible"}, ""),
    ({"back_visible": "invisible", "back_status": "wrong color"}, "invalid_back_status_for_invisible:wrong color;result_mismatch_expected_wrong"),
    ({"front_visible": "maybe"}, "invalid_front_visible:maybe"),
    ({"side_status": "paired box completion"}, "invalid_side_status_for_visible:paired box completion"),
    ({"result": "ok"}, "invalid_result:ok"),
    ({"value": ""}, "missing_value"),
])
def test_gold_rows(spark, change, issues):
    row = dict(zip(V.GOLD_COLUMNS, GOOD, strict=True)) | change
    r = quality.check_gold(rows_of(spark, [row.values()], V.GOLD_COLUMNS)).first()
    assert (r.issues, r.qc_status, r.row_number) == (issues, "FAIL" if issues else "PASS", 2)


def test_gold_registry_and_repeats(spark):
    d = rows_of(spark, [GOOD, GOOD, ("s9", *GOOD[1:]), ("s1", "rX", *GOOD[2:])], V.GOLD_COLUMNS)
    samples, rules = rows_of(spark, [("s1", "c")], ["sample_id", "category"]), rows_of(spark, [("s1", "r1", "red")], ["sample_id", "rule_id", "value"])
    got = [r.issues for r in quality.check_gold(d, samples, rules).orderBy("row_number").collect()]
    assert got == ["", "duplicate_rule_id_for_sample", "unknown_sample_id", "rule_id_not_in_atomic_rules"]
    missing = quality.check_gold(d.drop("result")).first()
    assert missing.issues == "missing_column:result" and missing.qc_status == "FAIL"
    with pytest.raises(ValueError):
        quality.fail_on_errors(quality.check_gold(d.drop("result")))


def test_findings_and_audit(spark):
    columns = (*V.FINDING_COLUMNS, "element_name", "severity")
    d = rows_of(spark, [("s1", "c", "f1", "front", "wrong color", "hat", "major"), ("s1", "c", "f1", "top", "odd", "", "huge")], columns)
    got = [(r.qc_status, r.issues, r.warnings) for r in quality.check_findings(d, rows_of(spark, [("s1", "d")], ["sample_id", "category"])).orderBy("row_number").collect()]
    assert got[0] == ("WARN", "", "category_mismatch_expected_d")
    assert got[1][1] == "missing_feature_key_or_human_rule_name_or_element_name;invalid_view:top;invalid_issue_type:odd;invalid_severity:huge;duplicate_finding_id_for_sample"
    base = dict.fromkeys(V.AUDIT_COLUMNS, "x") | {"sample_id": "s1", "rule_validity": "correct"}
    cases = [base, base | {"rule_id": "b", "rule_validity": "wrong_value", "corrected_value": ""}, base | {"rule_id": "c", "rule_validity": "ambiguous", "reason": ""}, base | {"rule_id": "d", "rule_validity": "odd"}]
    got = [(r.qc_status, r.issues, r.warnings) for r in quality.check_audit(rows_of(spark, [c.values() for c in cases], V.AUDIT_COLUMNS)).orderBy("row_number").collect()]
    assert got == [("PASS", "", ""), ("FAIL", "missing_corrected_value_for_wrong_value", ""), ("WARN", "", "non_correct_without_reason"), ("FAIL", "invalid_rule_validity:odd", "")]


def test_prediction_check(spark):
    d = rows_of(spark, [("s1", *GOOD[1:9], "unsure"), ("s1", "r2", *GOOD[2:])], V.GOLD_COLUMNS)
    want = rows_of(spark, [("s1", "r1"), ("s1", "r3")], ["sample_id", "rule_id"])
    assert {r.rule_id: (r.qc_status, r.issues, r.warnings) for r in quality.check_predictions(d, want).collect()} == {"r1": ("PASS", "", ""), "r2": ("WARN", "", "rule_id_not_in_expected_set"), "r3": ("FAIL", "missing_from_output", "")}
    legacy = rows_of(spark, [("s1", "r1", "v", "TRUE", "maybe", "FALSE", "wrong", "")], ["sample_id", "rule_id", "value", *V.VIEWS, "result", "reason"])
    r = quality.check_legacy(legacy).first()
    assert (r.issues, r.warnings) == ("invalid_side:maybe", "wrong_without_reason")


def test_end_to_end_scores(spark):
    columns = (*V.GOLD_COLUMNS, "category")
    annotated = rows_of(spark, [("s1", "hair_color", "red", "visible", "wrong color", "visible", "correct", "visible", "correct", "wrong", "backpack"), ("s1", "outfit_type", "dress", *["visible", "correct"] * 3, "correct", "backpack"), ("s1", "lost", "x", *["visible", "correct"] * 3, "correct", "backpack")], columns)
    audit_rows = rows_of(spark, [("s1", "backpack", "hair_color", "red", "correct", ""), ("s1", "backpack", "outfit_type", "dress", "correct", ""), ("s1", "backpack", "hair_color", "red", "duplicate", "later rows do not count")], ["sample_id", "category", "rule_id", "atomic_value", "rule_validity", "reason"])

    def predicted(*statuses):
        return rows_of(spark, [("s1", "hair_color", "red", "visible", statuses[0], "visible", statuses[1], "visible", "correct", "wrong", "backpack")], columns)

    for statuses, want in ((("wrong color", "correct"), (1, 0, 0, 1.0, 1.0)), (("correct", "correct"), (0, 0, 1, 0.0, 0.0)), (("wrong color", "wrong shape"), (1, 1, 0, 0.5, 1.0))):
        s = gold_pipeline.score_predictions(annotated, audit_rows, predicted(*statuses))
        assert (s.verified.count(), [r.exclude_reason for r in s.excluded.collect()], s.gold_events.count()) == (2, ["missing_audit"], 1)
        r = s.overall.first()
        assert (r.tp, r.fp, r.fn, r.precision, r.recall) == want
    ok, out = gold.promote(annotated, audit_rows, allow_unaudited=True)
    assert out.count() == 0 and {r.rule_id: r.audit_rule_validity for r in ok.collect()}["lost"] == "unaudited"
    other = rows_of(spark, [("s2", "hair_color", "red", "visible", "correct", "visible", "correct", "visible", "correct", "correct", "backpack")], columns)
    assert gold_pipeline.score_predictions(annotated, audit_rows, other).overall.first().fn == 0
    assert gold_pipeline.score_predictions(annotated, audit_rows, other, missing_as_fn=True).overall.first().fn == 1
    assert [b for b, _ in gold.blocked_steps(annotated.limit(0), audit_rows, annotated)] == ["final coverage/generation quality metrics"]


def test_bag_match(spark):
    p = rows_of(spark, [("a",), ("a",), ("b",)], ["k"])
    g = rows_of(spark, [("a",), ("c",), ("c",)], ["k"])
    got = sorted((r.k, r.outcome) for r in events.bag_match(p, g, ["k"], ["_row"], ["_row"]).collect())
    assert got == [("a", "fp"), ("a", "matched"), ("b", "fp"), ("c", "fn"), ("c", "fn")]
    r = events.metrics(events.bag_counts(p, g, ["k"])).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 2)
    assert events.metrics(events.bag_counts(p.limit(0), g.limit(0), ["k"])).first()[:] == (0, 0, 0, 0.0, 0.0, 0.0)


def test_alignment(spark):
    f = rows_of(spark, [("s1", "c", "f1", "red hat", "red"), ("s1", "c", "f2", "zzz", ""), ("s9", "c", "f3", "red", "")], ["sample_id", "category", "finding_id", "element_name", "expected_value"])
    r = spark.createDataFrame([("", "s1", 0, "headwear_color", "red"), ("", "s1", 1, "boots", "blue"), ("c", "s7", 0, "x", "y")], "category string, sample_id string, position int, rule_id string, value string")
    found, review = alignment.align(f, r)
    got = {(x.human_finding_id, x.rank): x for x in found.collect()}
    a = got["f1", 1]
    import difflib

    ratio = difflib.SequenceMatcher(None, "red hat red", "headwear_color red").ratio()
    assert a.atomic_rule_id == "headwear_color" and a.mapping_score == pytest.approx(round(2 / 3 * 0.65 + 0.25 * ratio + 0.15, 4), abs=1e-4)
    assert a.candidate_match_type == "semantic_equivalent_candidate" and f"jaccard={2 / 3:.3f}" in a.mapping_reason
    assert got["f2", 1].mapping_reason == "no_candidate_above_min_score" and got["f3", 1].mapping_reason == "no_atomic_rules_for_sample"
    assert {x.human_finding_id for x in review.collect()} == {"f1", "f2", "f3"}


def test_best_assignment():
    rnd = random.Random(4)
    for _ in range(150):
        n, m = rnd.randrange(1, 6), rnd.randrange(1, 6)
        gain = np.array([[rnd.random() for _ in range(m)] for _ in range(n)])
        pairs = assignment.best_assignment(gain)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        small, large, g = (range(n), range(m), gain) if n <= m else (range(m), range(n), gain.T)
        best = max(sum(g[i, j] for i, j in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
        assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_matching_of_samples(spark):
    p = spark.createDataFrame(pd.DataFrame([("s1", 0, "短裙", "短裙", "clothing"), ("s1", 1, "腰带", "腰带", "accessory"), ("s2", 0, "x", "x", "other")], columns=["sample_id", "index", "name", "text", "category"])).withColumn("index", F.col("index").cast("int"))
    g = spark.createDataFrame(pd.DataFrame([("s1", 0, "短裙与腰带", "短裙与腰带"), ("s3", 0, "帽子", "帽子")], columns=["sample_id", "index", "name", "text"])).withColumn("index", F.col("index").cast("int"))
    best = assignment.optimal(p, g, "sample_id")
    assert [(r.sample_id, r.gold_index, r.similarity, r.match_quality) for r in best.collect()] == [("s1", 0, 1.0, "good")]
    e = {r.sample_id: r for r in assignment.evaluate(best, p, g, "sample_id").collect()}
    assert (e["s1"].coverage, e["s1"].precision, e["s2"].coverage, e["s3"].coverage) == (1.0, 0.5, 1.0, 0.0)
    assert assignment.overall(assignment.evaluate(best, p, g, "sample_id")).first().micro_coverage == 0.5
    parts = assignment.expand_compounds(g, F.lit(True)).withColumn("text", F.col("name"))
    taken = assignment.greedy(p, parts, "sample_id")
    cover = {(r.sample_id, r.gold_index): r.coverage for r in assignment.compound_coverage(taken, parts, "sample_id").collect()}
    assert cover == {("s1", 0): 1.0, ("s3", 0): 0.0}
    halves = assignment.greedy(p.filter("index = 1"), parts.filter("part >= 0"), "sample_id")
    assert {r.gold_index: r.coverage for r in assignment.compound_coverage(halves, parts, "sample_id").collect() if r.sample_id == "s1"} == {0: 0.5}
    near = assignment.relaxed_matches(p, g, best, "sample_id", F.lit(0.7)).collect()
    assert len(near) == 1 and near[0].sample_id == "s1"
    by = {r.category: (r.total_pred, r.matched) for r in assignment.category_precision(p, best, "sample_id").collect()}
    assert sum(m for _, m in by.values()) == 1 and by["other"] == (1, 0)


ELEMENT = "sample_id string, index int, name string, value string, category string, color string, material string, shape string, location string"


def test_coverage(spark):
    def elements(*rows):
        return spark.createDataFrame([("s", k, n, v, "", "", "", "", "") for k, (n, v) in enumerate(rows)], ELEMENT)

    g = elements(("红色外套", ""), ("短裙与腰带", ""), ("剑", ""), ("长款外套", ""))
    p = elements(("蓝色外套", ""), ("短裙", ""), ("腰带", "布质"), ("天空", ""), ("短款外套", ""))
    a = {r.gold_index: r for r in coverage.audit_gold(g, p).collect()}
    assert a[0].covered and a[0].covering == [0] or a[0].covered
    assert any("color conflict" in n for n in a[0].conflict_notes)
    assert a[1].covered and sorted(a[1].covering) == [1, 2] and a[1].missing == []
    assert not a[2].covered and a[2].missing == ["weapon"]
    assert a[3].covered
    extra = {r.pred_index: r.classification for r in coverage.extras(g, p, coverage.audit_gold(g, p)).collect()}
    assert extra[3] == "needs_review"
    t = coverage.totals(coverage.audit_gold(g, p), coverage.extras(g, p, coverage.audit_gold(g, p)), 8).first()
    assert (t.gold_count, t.covered_gold_count, t.gold_coverage_rate, t.all_gold_coverage_rate) == (4, 3, 0.75, 0.375)

    def pair(x, y):
        pairs = coverage.prepared(elements((x, "")), "gold").join(coverage.prepared(elements((y, "")), "pred"), "sample_id")
        return pairs.select(coverage.relation().alias("s"), coverage.conflicts().alias("c")).first()

    assert pair("红色帽子", "红色帽子").s == 1.0 and pair("帽子", "天空").s == 0.0
    assert pair("红色外套", "蓝色外套").c.notes and pair("长款外套", "短款外套").c.notes[0].startswith("shape conflict")
    assert pair("布质腰带", "腰带带金属搭扣").c.notes == []
    assert pair("红色外套", "粉色外套").c.notes == [] and pair("红色外套", "粉色外套").c.tolerated == ["pink", "red"]


def test_scores(spark):
    d = spark.createDataFrame([(1, "full_body looking_at_viewer standing solo", "100", "100"), (2, "full_body looking_at_viewer sitting", "", ""), (3, "hat white_background", "300", "100"), (4, "full_body front_view sword", "0", "5")], "sample_id int, tags string, width string, height string")
    got = {r.sample_id: r for r in scoring.assign(scoring.score(d)).collect()}
    assert got[1].score_plush == 10 + 8 - 12 + 18 + 18 and got[2].score_dataset_QSitFigures > got[1].score_dataset_QSitFigures - 8
    assert all(got[3][f"score_{c}"] <= -100 for c in V.BODY_CATEGORIES) and got[3].reason.endswith("head_only_only_not_full_body")
    assert got[4].score_dataset_figurine > got[4].score_cake_roll and got[3].primary_category == "cake_roll" and "hat" in got[3].key_tags
    assert 3 <= len(got[1].candidate_categories.split("|")) <= 4


@pytest.mark.parametrize("seed", range(3))
def test_balanced_assignment(spark, seed):
    rnd = random.Random(seed)
    names = V.CATEGORIES
    data = [(f"id{k:03d}", *[rnd.randrange(6) * 10 for _ in names], rnd.choice(names) if rnd.random() < 0.2 else "") for k in range(120)]
    d = spark.createDataFrame(data, "sample_id string, " + ", ".join(f"score_{c} int" for c in names) + ", already_generated_category string")
    room = {c: 120 // 6 for c in names}
    for r in data:
        if r[-1]:
            room[r[-1]] = max(0, room[r[-1]] - 1)
    want = {r[0]: r[-1] for r in data if r[-1]}
    order = lambda r: sorted(range(6), key=lambda k: (-r[1 + k], k))
    for r in sorted((r for r in data if not r[-1]), key=lambda r: (-(sorted(r[1:7])[-1] - sorted(r[1:7])[-2]), r[0])):
        c = next(names[k] for k in order(r) if room[names[k]] > 0)
        room[c] -= 1
        want[r[0]] = c
    assert {r.sample_id: r.assigned for r in scoring.balanced(d).collect()} == want


def test_accept_first(spark):
    rnd = random.Random(8)
    data = [(k, f"a{rnd.randrange(30)}", f"b{rnd.randrange(40)}" if rnd.random() < 0.9 else "") for k in range(150)]
    d = spark.createDataFrame(data, "o long, a string, b string")
    old = spark.createDataFrame([("a1", "b2")], "a string, b string")
    for seen, start in ((None, set()), (old, {("a", "a1"), ("b", "b2")})):
        have, want = set(start), set()
        for o, a, b in data:
            keys = {("a", a), ("b", b)} - {("b", "")}
            if not keys & have:
                want.add(o)
                have |= keys
        assert {r.o for r in curation.accept_first(d, "o", ["a", "b"], seen).filter("kept").collect()} == want
    assert curation.accept_first(d.limit(0), "o", ["a"]).count() == 0


POST = "id string, tags string, rating string, sample_width string, sample_height string, width string, height string, source string, crawl_label string, raw_tags string"
SHEET = "multiple_views solo turnaround 1girl zed"


@pytest.mark.parametrize("change, reason", [
    ({}, "prefilter_pass"),
    ({"id": ""}, "duplicate_post_id"),
    ({"rating": "explicit"}, "not_safe"),
    ({"tags": "solo 1girl"}, "missing_sheet_tag"),
    ({"tags": "turnaround 1girl solo"}, "missing_required_tags:multiple_views"),
    ({"tags": SHEET + " 2boys"}, "not_single_human_subject"),
    ({"tags": SHEET + " sketch chibi"}, "negative_tags:chibi,sketch"),
    ({"tags": SHEET + " mermaid"}, "non_human_tags:mermaid"),
    ({"tags": SHEET + " bust"}, "partial_view_tags:bust"),
    ({"width": "449"}, "too_small"),
    ({"width": "449", "sample_width": "450"}, "prefilter_pass"),
    ({"tags": "multiple_views solo model_sheet 1girl zed"}, "weak_sheet_signal"),
    ({"raw_tags": "turnaround other"}, "missing_positive_series_tag"),
    ({"tags": SHEET + " wings"}, "prefilter_pass;signature_features:wings"),
    ({"crawl_label": "official_full_body_x", "tags": "1girl"}, "missing_full_body"),
    ({"crawl_label": "official_full_body_x", "tags": "1girl full_body"}, "missing_official_art"),
])
def test_cascade(spark, change, reason):
    row = {"id": "1", "tags": SHEET, "rating": "safe", "sample_width": None, "sample_height": None, "width": "500", "height": "500", "source": "", "crawl_label": "sheets", "raw_tags": "turnaround zed -comic rating:safe"} | change
    r = curation.cascade(spark.createDataFrame([tuple(row.values())], POST)).first()
    assert r.reason == reason and r.accepted == reason.startswith("prefilter_pass")


def test_duplicates(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(15)]
    hashes = base + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(8))) for b in base for _ in range(4)] + base[:3]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    d = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    members, pairs = duplicates.near_pairs(d, "id", "h")
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    want = {(a, b, (x ^ y).bit_count()) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if (x ^ y).bit_count() <= 5}
    got = [(r.a, r.b, r.hamming_distance) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(min(a, b), max(a, b), n) for a, b, n in want}
    assert {r.id: r.class_id for r in members.collect()} == {k: first[h] for k, h in enumerate(hashes)}
    assert duplicates.report_pairs(pairs, 2).filter("truncated").count() == 2
    groups = duplicates.exact_groups(d, "h", "id")
    assert {r.group_id for r in duplicates.group_numbers(groups).collect()} == set(range(1, 1 + len({h for h in hashes if hashes.count(h) > 1})))
    s = spark.createDataFrame([(k, "x" if k % 3 else "y") for k in range(120)], "id int, s string")
    out = duplicates.signature_groups(s, "kind", "s", "id", "id").collect()
    assert [(r.signature, r.sample_count, len(r.sample_ids.split())) for r in out] == [("x", 80, 50), ("y", 40, 40)]
    assert [r.sources for r in duplicates.ids_in_sources(spark.createDataFrame([(1, "b"), (1, "a"), (2, "a")], "raw int, src string"), "raw", "src").collect()] == ["a|b"]


def test_fidelity(spark):
    specs = dict.fromkeys(V.SPEC_POINTS, True)
    record = ("s1", [("a", 1.0, "preserved", "e"), ("b", 1.0, "partial", "e")], specs, 0.9, 0.8, [])
    make = lambda *r: spark.createDataFrame([r], fidelity.RECORD)
    r = fidelity.scored(make(*record)).first()
    assert (r.element_points, r.total, r.label, r.requires_human_review) == (45.0, pytest.approx(82.5), "review", True)
    r = fidelity.scored(make("s1", [("a", 1.0, "preserved", "e"), ("b", 5.0, "unverifiable", "e")], specs, 1.0, 1.0, [("x", "minor")])).first()
    assert (r.total, r.label) == (98.0, "review")
    r = fidelity.scored(make("s1", record[1], specs | {"full_body": False}, 0.4, 1.0, [("x", "critical")])).first()
    assert r.label == "fail" and r.critical_reasons == ["critical_hallucination", "failed_full_body", "identity_below_0.5"]
    for bad in (("", *record[1:]), ("s1", [], *record[2:]), ("s1", [("a", 1.0, "odd", "e")], *record[2:]), ("s1", [("a", 0.0, "preserved", "e")], *record[2:]), ("s1", [("a", 1.0, "unverifiable", "e")], *record[2:]), (*record[:2], {"front_view": True}, *record[3:]), (*record[:3], 1.4, *record[4:]), (*record[:5], [("", "minor")])):
        with pytest.raises(Exception, match="s1|sample_id|must be"):
            fidelity.scored(make(*bad)).collect()


def test_lanes(spark):
    def rule(front="correct", issue="none", result="correct", confidence="high", evidence=()):
        return ("r", "v", "visible", front, "visible", "correct", "visible", "correct", result, issue, confidence, " why ", list(evidence))

    cases = {
        "pass": ([rule()], 0, 0),
        "fail": ([rule("wrong_color", evidence=[("front", "seen"), ("back", "no")])], 1, 0),
        "minor_issue": ([rule("extra")], 0, 1),
        "unsure": ([rule(confidence="0.2")], 0, 0),
    }
    for want, (rules, billable, design) in cases.items():
        d = spark.createDataFrame([(rules,)], f"rules array<{lanes.RULE}>").withColumn("rules", lanes.normalized(F.col("rules")))
        r = lanes.review(d).first()
        assert (r.overall_decision, len(r.billable_issues), len(r.design_notes)) == (want, billable, design)
        if want == "fail":
            assert r.billable_issues[0].issue_type == "wrong color" and [e.note for e in r.billable_issues[0].evidence] == ["seen"] and r.wrong_rules == 1
        if want == "minor_issue":
            assert r.design_notes[0].evidence[0].note == "why" and r.design_notes[0].severity == "medium"
    d = spark.createDataFrame([([rule(issue="paired box completion")],)], f"rules array<{lanes.RULE}>")
    assert [x.view for x in lanes.review(d).first().billable_issues] == ["overall"]
    asked = F.array(F.struct(F.lit("new").alias("rule_id"), F.lit("nv").alias("value")))
    assert d.select(lanes.locked(F.col("rules"), asked)[0]["rule_id"]).first()[0] == "new"
    assert d.select(lanes.locked(F.col("rules"), F.array_repeat(asked[0], 2))[0]["rule_id"]).first()[0] == "r"


def test_detection(spark):
    e = spark.createDataFrame([("s", "s_e001", 1, "a", "", "wrong", "color", "红色偏粉", ""), ("s", "s_e002", 2, "b", "", "wrong", "color", "红 与 蓝", ""), ("s", "s_e003", 3, "红色与棕色", "", "wrong", "shape", "", ""), ("t", "t_e001", 1, "c", "", "correct", None, "", "")], "sample_id string, element_id string, position int, name string, expected_value string, verdict string, issue_type string, reason string, evidence string")
    d = detection.downgraded(e)
    got = {r.element_id: r for r in d.collect()}
    assert got["s_e001"].verdict == "correct" and got["s_e001"].issue_type is None and got["s_e001"].postprocess.matched_color_families == ["pink", "red"]
    assert got["s_e002"].verdict == "wrong" and got["s_e002"].postprocess is None
    m = spark.createDataFrame([("s", 2, "color"), ("s", 3, "color"), ("t", 1, "shape"), ("u", 1, "shape")], "negative_sample_id string, mutated_element_index int, expected_issue_type string")
    s = detection.detection_summary(detection.detection(e, m)).first()
    assert (s.target_total, s.target_caught, s.issue_matched, s.missed, s.issue_mismatches, s.extra_wrong_count) == (4, 2, 1, 2, 1, 4)
    assert [(r.expected_issue_type, r.total, r.caught) for r in detection.caught_by_issue(detection.detection(e, m)).collect()] == [("color", 2, 2), ("shape", 2, 0)]
    assert detection.verdict_counts(d).first()[:] == (4, 2, 2, 0) and [(r.issue_type, r.n) for r in detection.issue_counts(d).collect()] == [("color", 1), ("shape", 1)]


def test_queue_and_jobs(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    got = queue.partition(ids(*"abcde"), ids("a"), ids("a", "b"), ids("b", "c"), ids("c", "d"))
    assert {r.sample_id: r.state for r in got.collect()} == dict(zip("abcde", queue.STATES, strict=True))
    jobs = queue.job_manifest(ids("a", "b"), [1, 2], "p", "m", "prompt", "v1", "run", "/out/")
    assert sorted(r.job_id for r in jobs.collect()) == ["a_seed1", "a_seed2", "b_seed1", "b_seed2"]
    ev = spark.createDataFrame([("a_seed1", "running"), ("a_seed2", "succeeded")], "job_id string, to string")
    after = {r.job_id: (r.status, r.attempt) for r in queue.transition(jobs, ev).collect()}
    assert after == {"a_seed1": ("running", 1), "a_seed2": ("pending", 0), "b_seed1": ("pending", 0), "b_seed2": ("pending", 0)}
    assert [r.n for r in queue.run_summary(jobs).collect()] == [4]


def test_dataset_audit(spark, tmp_path):
    import json

    from sparloom.sources.documents import read_documents

    root = tmp_path / "d"
    root.mkdir()
    docs = {"a.json": {"sample_id": "s1", "source_image": "a.png", "elements": [{"name": "x", "value": "1"}, {"name": "x", "value": "2"}, {"name": ""}, 5]}, "b.json": {"sample_id": "s1", "source_image": "gone.png", "elements": {}}, "c.json": [1], "e.json": {"source_image": "/abs.png", "elements": []}}
    for name, data in docs.items():
        (root / name).write_text(json.dumps(data))
    (root / "d.json").write_text("{")
    d = read_documents(spark, f"{root}/*.json")
    base = d.first().path.rsplit("/", 1)[0]
    images = spark.createDataFrame([(f"{base}/a.png", "h1", 10, 20), (f"{base}/b.png", "h1", None, None)], "path string, sha256 string, width int, height int")
    issues = audit.audit(d, images)
    assert sorted(r.code for r in issues.collect()) == sorted(["invalid_json", "invalid_root", "invalid_sample_id", "absolute_source_path", "missing_source_image", "missing_source_image", "invalid_elements", "invalid_element", "invalid_element_name", "duplicate_element_names", "duplicate_sample_id", "duplicate_sample_id", "duplicate_image", "duplicate_image", "orphan_image"])
    s = audit.audit_summary(issues, d, images).first()
    assert (s.json_files, s.image_files, s.warning_count, s.max_width) == (5, 2, 5, 10)
    assigned = spark.createDataFrame([("a", "c1", "h"), ("b", "c1", "h"), ("c", "c2", "x")], "sample_id string, category string, sha256 string")
    manifest = spark.createDataFrame([("a", "h"), ("b", "other"), ("z", "q")], "sample_id string, sha256 string")
    assert sorted(r.problem for r in audit.smoke_problems(assigned, manifest).collect()) == ["category_count", "duplicate_sha256", "hash_differs", "not_assigned", "not_in_manifest", "row_count"]


def test_basics(spark):
    d = spark.createDataFrame([("x", 3), ("y", 1), ("x", 2), ("z", 5)], "k string, o int")
    assert sorted((r.k, r.o) for r in basics.keep_first(d, ["k"], ["o"]).collect()) == [("x", 2), ("y", 1), ("z", 5)]
    assert [(r.k, r.n) for r in basics.count_by(d, "k").collect()] == [("x", 2), ("y", 1), ("z", 1)]
    assert [r.k for r in basics.frequencies(d, ["k"], "o").collect()] == ["x", "y", "z"]
    assert [r.k for r in basics.distinct_in_order(d, "k", "o").collect()] == ["y", "x", "z"]
    assert [r.quota for r in basics.even_quotas(spark.createDataFrame([("a",), ("b",), ("c",)], "n string"), F.lit(8), "n").orderBy("n").collect()] == [3, 3, 2]
    big = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o"))
    assert [r._place for r in basics.global_place(big, [F.col("o")]).orderBy("o").collect()] == list(range(1000))
    assert [r.category for r in basics.round_robin(d, "o", ["p", "q"]).orderBy("o").collect()] == ["p", "q", "p", "q"]
    assert [r.o for r in basics.ranked_slice(d, ["k"], ["o"], F.lit(1), 1).collect()] == [3]
    done = spark.createDataFrame([("x",)], "k string")
    assert sorted(r.k for r in basics.without(d, done, "k").collect()) == ["y", "z"] and basics.without(d, done, "k", 1, "o").first().k == "y"
    table = spark.createDataFrame([("c", "s", "exact"), ("", "s", "loose"), ("", "t", "only")], "category string, sample string, v string")
    asked = spark.createDataFrame([("c", "s"), ("d", "s"), ("d", "t"), ("d", "u")], "category string, sample string")
    assert [r.v for r in basics.lookup(asked, table, ["category", "sample"], ["sample"], "v").orderBy("sample", "category").collect()] == ["exact", "loose", "only", None]
    assert sorted((r.k, r.side) for r in basics.reference_gaps(d, spark.createDataFrame([("x",), ("w",)], "k string"), "k").collect()) == [("w", "right_only"), ("y", "left_only"), ("z", "left_only")]
    assert curation.new_rows(d.limit(1), d, 3, "o").count() == 3
    assert curation.query_groups({"p": {"l": ["q1", "q2"]}}, spark).count() == 2


def test_templates_and_extraction(spark):
    s = spark.createDataFrame([("s1", "c"), ("s1", "c"), ("s2", "c")], "sample_id string, category string")
    r = spark.createDataFrame([("s1", "hair", "red", 0), ("s1", "coat", "blue", 1)], "sample_id string, rule_id string, value string, position int")
    t = templates.templates(s, r)
    assert (t["findings"].count(), t["gold"].count(), t["audit"].first().atomic_value in ("red", "blue")) == (2, 2, True)
    assert {x.sample_id: x.rule_count for x in t["manifest"].collect()} == {"s1": 2, "s2": 0}
    assert spark.range(1).select(templates.prompt("Look.\n", F.lit("s"), F.lit("c"), F.array(F.lit("r")))).first()[0] == 'Look.\n\n{"sample_id":"s","category":"c","atomic_rules":["r"]}'
    answers = spark.createDataFrame([("a", '```json\n{"elements": [{"name": ""}, {"name": "hat", "attributes": {"color": "red"}, "confidence": "0.9", "category": "Head Wear"}]}\n```'), ("b", '{"atomic_rules": [{"description": "a long description of a thing"}]}'), ("c", '{"identity_features": {"hair": {"color": "red", "parts": ["x", "y"], "none": ""}, "eye": "blue"}}'), ("d", "nothing")], "sample_id string, answer string")
    got = {x.element_id: x for x in extraction.elements(answers).collect()}
    assert set(got) == {"a_e002", "b_e001", "c_e001", "c_e002"} and got["a_e002"].value == "hat" and got["a_e002"].confidence == "high" and got["a_e002"].category == "other"
    assert got["b_e001"].name == "a long description o" and sorted(x.value for x in got.values() if x.sample_id == "c") == ["blue", "color: red；parts: x；y"]
    assert extraction.as_rules(extraction.elements(answers)).count() == 4
