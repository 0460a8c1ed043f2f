"""Every operator on rows with nulls, empty and long texts, repeats, clashing columns, and on no rows."""

import pytest
from pyspark.sql import functions as F

from sparloom.llm import decontamination, html_text, license_scan, lm_scoring, mixing, pii, quality_rules, simhash, substring_dedup, url_filters


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "one two")], "item_id long, text string")


PER_ROW = {
    "mixing": lambda d: mixing.mix(d),
    "quality": lambda d: quality_rules.judge(d),
    "pii": lambda d: pii.find(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "license": lambda d: license_scan.scan(d),
    "lm": lambda d: lm_scoring.score(d, lm_scoring.train_model(d.filter(lm_scoring.is_training(F.col("doc_id"))).select("text"))),
    "urls": lambda d: url_filters.judge(d, "doc_id", "text"),
    "html": lambda d: html_text.main_text(d, "doc_id", "source", "text"),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(name, odd, none):
    assert PER_ROW[name](odd).count() == odd.count()
    assert PER_ROW[name](none).count() == 0


def test_findings_only(spark, odd, none):
    found = decontamination.contaminated(odd, bench(spark)).collect()
    assert {(r.doc_id, r.item_id, r.covered) for r in found} == {(1, 1, 5 + 1)}
    assert decontamination.contaminated(none, bench(spark)).count() == 0
    assert decontamination.contaminated(odd, bench(spark).limit(0)).count() == 0
    assert {r.doc_id for r in substring_dedup.passages(odd, min_words=5).collect()} == {1}
    assert substring_dedup.passages(none).count() == 0


def test_filters_keep_columns(spark, odd, none):
    steps = {"quality": quality_rules.keep_documents, "one": simhash.keep_one, "similar": simhash.keep_similar_once, "clean": lambda d: decontamination.clean_documents(d, bench(spark)), "redact": lambda d: pii.redact(d, length_col="n_chars")}
    for step in steps.values():
        assert step(odd).columns == odd.columns
        assert step(none).count() == 0
    for d in (odd, none):
        assert mixing.mixture(d).columns == [*odd.columns, "_copy", "_size", "_source_size", "__target", "_taken"]
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert mixing.mixture(plain.limit(0)).count() == 0
    mixed = mixing.mixture(plain).collect()
    assert all(r.copy >= 1 for r in mixed)


def test_defined_results(odd):
    found = {r.doc_id: r for r in lm_scoring.score(odd, lm_scoring.train_model(odd.select("text"))).collect()}
    assert found[2].n_tokens == 1 and found[3].n_tokens == 1 and found[5].n_tokens == 60_001
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect() if r.doc_id}
    assert groups[2] == groups[3] == groups[4] == 2
    assert groups[1] == 1
    lic = {r.doc_id: r for r in license_scan.scan(odd).collect() if r.doc_id}
    assert lic[3].n_words == 0 and lic[3].first_word is None and lic[3].labels == ""
    q = {r.doc_id: r for r in quality_rules.judge(odd).collect() if r.doc_id}
    assert q[3].base_failed and q[1].n_words == 10 and q[5].n_repeat_words == 60_000
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.find(odd).collect() if r.doc_id}
    assert spans[6] == [(0, 10, 16)]


def test_redaction(spark):
    d = spark.createDataFrame([(1, "x a@b.co y 1.2.3.4 +12345678", 3), (2, None, None), (3, "nothing", 7)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(d, length_col="n_chars").collect()}
    assert got == {1: ("x <email> y <ip> <phone>", 24), 2: (None, None), 3: ("nothing", 7)}


def test_a_row_in_a_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base + " more"), (4, "another text with words that differ in all places"), (4, "another text with words that differ in all places")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_two_texts_under_one_id_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (2, "alpha beta gamma delta epsilon"), (None, "seven eight nine ten eleven"), (None, "seven eight nine ten eleven")]
    for step in (simhash.keep_one, simhash.keep_similar_once):
        kept = step(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, rows[3][1]), *sorted(rows[:2])]
