"""White space of any script, rounding, keys that repeat, listings that end, workbooks that are rewritten."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions import parsing, text
from sparloom.operators import basics, duplicates
from sparloom.sinks import writers
from sparloom.sources import documents, workbooks
from sparloom.sources.pages import PagedSource

BLANKS = ["\t", "\n", "　", "\xa0", " ", " ", "\x1f", " "]


def test_white_space_of_any_script(spark):
    rows = [(k, f"{b}a{b}b{b}") for k, b in enumerate(BLANKS)]
    d = spark.createDataFrame(rows, "k int, t string")
    got = d.select("k", text.clean(F.col("t")).alias("clean"), text.compact_text(F.col("t"), strip_ascii=False).alias("compact"), F.size(text.char_set(F.concat("t", F.lit("，《")), strip_ascii=False)).alias("n")).collect()
    for r in got:
        assert (r.clean, r.compact, r.n) == (f"a{BLANKS[r.k]}b".strip(), "ab", 2)
    assert set(V.WHITE) == {chr(c) for c in range(0x10000) if chr(c).isspace()}


def test_rounding_is_that_of_binary_values(spark):
    rnd = random.Random(3)
    values = [0.28125, 0.12345, 0.99995, 0.5, 0.0, 1.05, 0.18, 2.675, 0.86, 7.99995] + [1 / 128 + rnd.random() * 2 for _ in range(3000)] + [k / 20000 for k in range(160, 2000)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for r in d.select("v", parsing.rounded(F.col("v"), 4).alias("r"), parsing.rounded(F.col("v"), 2).alias("s")).collect():
        assert (r.r, r.s) == (round(r.v, 4), round(r.v, 2)), r.v


def test_lookup_never_multiplies_rows(spark):
    t = spark.createDataFrame([("c", "s", "1", 0), ("c", "s", "0", 1), ("", "s", "x", 2), ("", "s", "y", 3)], "category string, sample_id string, value string, at int")
    d = spark.createDataFrame([(1, "c", "s"), (2, "d", "s"), (3, "d", "z")], "k int, category string, sample_id string")
    got = {r.k: r.value for r in basics.lookup(d, t, ["category", "sample_id"], ["sample_id"], "value", "at").collect()}
    assert got == {1: "0", 2: "y", 3: None}
    assert basics.lookup(d, t, ["category", "sample_id"], ["sample_id"], "value").count() == 3


def test_repeats_and_group_numbers(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b"), (6, "a")], "n int, k string")
    assert {r.n for r in basics.flag_repeats(d, ["k"], ["n"]).filter("is_repeat").collect()} == {3, 4, 6}
    groups = duplicates.group_numbers(duplicates.exact_groups(d.filter("k is not null"), "k", "n"))
    assert [(r.group_first, r.group_id) for r in groups.collect()] == [(1, 1)]


def test_a_listing_ends_at_an_empty_page(spark, tmp_path):
    for k, posts in enumerate(([{"id": 1}, {"id": 2}], {"post": {"id": 3}}, [], [{"id": 9}])):
        (tmp_path / f"{k}.json").write_text(json.dumps(posts))
    spark.dataSource.register(PagedSource)
    read = spark.read.format("paged").option("location", str(tmp_path)).option("fetcher", "sparloom.sources.pages:read_file")
    assert sorted(r.post_id for r in read.load().collect()) == ["1", "2", "3"]
    assert sorted(r.post_id for r in read.option("pages", 4).load().collect()) == ["1", "2", "3", "9"]


def test_rules_of_other_roots_do_not_count(spark):
    samples = spark.createDataFrame([("c", "s", "data/s/rules.json", "p", 0)], "category string, sample_id string, atomic_rules string, path string, position int")
    rules = spark.createDataFrame([("/a/data/s/rules.json", "r"), ("/a/old/s/rules.json", "q")], "path string, rule_id string")
    assert [r.rule_id for r in documents.registered_rules(samples, rules).collect()] == ["r"]
    assert [r.rule_id for r in documents.registered_rules(samples, rules.filter("rule_id = 'q'")).collect()] == ["q"]


def test_a_rewrite_keeps_its_cells(spark):
    cells = lambda rows: spark.createDataFrame(rows, "path string, source_row int, cells array<string>")
    before = cells([("a", 1, ["h", "k"]), ("a", 2, ["1", ""])])
    workbooks.assert_unchanged(before, cells([("a", 1, ["h", "k"]), ("a", 2, ["1"])]), ["path"])
    with pytest.raises(ValueError, match="changed"):
        workbooks.assert_unchanged(before, cells([("a", 1, ["h", "k"]), ("a", 2, ["2"])]), ["path"])


def test_a_review_without_rows_is_not_written(spark, tmp_path):
    d = spark.createDataFrame([(1, "x", None), (2, None, "y")], "n int, a string, b string")
    assert not writers.write_review(d.limit(0), f"{tmp_path}/none", [F.col("n")])
    assert writers.write_review(d, f"{tmp_path}/some", [F.col("n")])
    assert spark.read.option("header", True).csv(f"{tmp_path}/some").columns == ["n", "a"]
