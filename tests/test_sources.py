import json

import pytest
from pyspark.sql import functions as F

from sparloom.operators.updates import apply_updates, checked_rules, position_rules
from sparloom.plans import products
from sparloom.sinks import writers
from sparloom.sources import documents, layout, pages, tables, workbooks


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id, name\n1, x \n1,\"two\nlines \"\"q\"\"\"\n,z\n".encode())
    d = tables.read_csv(spark, str(tmp_path))
    assert d.columns[:2] == ["id", " name"] or d.columns[:2] == ["id", "name"]
    rows = sorted((r[0], r[1]) for r in d.collect())
    assert rows == [("", "z"), ("1", 'two\nlines "q"'), ("1", "x")]
    last = tables.last_by_key(d, "id").collect()
    assert [r[1] for r in last] == ['two\nlines "q"'] and tables.with_key(d, "id").count() == 2
    assert tables.read_csv(spark, str(tmp_path / "no.csv"), ["id"], missing_ok=True).count() == 0
    with pytest.raises(Exception, match="duplicate id|blank id"):
        tables.read_samples(spark, str(tmp_path), "id").collect()


def test_json_and_lists(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in tables.read_json(spark, str(tmp_path / "a.jsonl"), "a int").collect() if r.a) == [1, 2]
    (tmp_path / "b.json").write_text('[{"a": 3}, {"a": 4}]')
    assert sorted(r.a for r in tables.read_json(spark, str(tmp_path / "b.json"), "a int", lines=False).collect()) == [3, 4]
    assert tables.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "ids.txt").write_text("s1, s2 # old\n\n# all\n s3 s4\n")
    assert sorted(r.item for r in tables.read_lines(spark, str(tmp_path / "ids.txt")).collect()) == ["s1", "s2", "s3", "s4"]


def test_rule_documents(spark, tmp_path):
    for name, data in {"s1": {"atomic_rules": [{"rule_id": "hair_color", "value": "red", "location": "Head"}, {"id": "x_position", "value": "left side"}, {"name": "n", "value": True}, 5, {"value": "lost"}]}, "s2": [{"id": "Hair Color", "value": 3, "location": "head"}, {"id": "hair_color", "value": "later", "location": "head"}]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "rules.json").write_text(json.dumps(data))
    (tmp_path / "s3").mkdir()
    (tmp_path / "s3" / "rules.json").write_text("{broken")
    docs = documents.read_documents(spark, f"{tmp_path}/*/rules.json")
    assert docs.filter("v is null").count() == 1
    r = documents.rules(docs).withColumn("sample_id", documents.sample_of())
    assert sorted((x.sample_id, x.position, x.rule_id, x.location, x.value) for x in r.collect()) == [("s1", 0, "hair_color", "head", "red"), ("s1", 1, "x_position", "", "left side"), ("s1", 2, "n", "", "true"), ("s2", 0, "Hair Color", "head", "3"), ("s2", 1, "hair_color", "head", "later")]
    assert [(x.rule_id, x.value) for x in checked_rules(r.filter("sample_id = 's2'")).collect()] == [("hair_color", "3")]
    with pytest.raises(Exception, match="location"):
        checked_rules(r.filter("sample_id = 's1'")).collect()
    asked = position_rules(r, only_sides=True)
    assert [(x.rule_id, x.position_index) for x in asked.collect()] == [("x_position", 0)]
    path = asked.first().path
    for update, changed in (((path, 0, "0", "x_position", "left side", " right side "), True), ((path, 0, None, "x_position", "left side", "right side"), True), ((path, 0, "0", "x_position", "stale", "right"), False), ((path, 0, "0", None, None, "left side"), False)):
        u = spark.createDataFrame([update], "path string, ordinal int, position_index string, id string, old_value string, corrected_value string")
        got = {x.rule_id: (x.changed, x.new_value) for x in apply_updates(r.filter("sample_id = 's1'"), asked, u).collect()}
        assert got["x_position"] == (changed, "right side" if changed else "left side") and not got["hair_color"][0]
    assert documents.read_documents(spark, f"{tmp_path}/nothing/*.json").count() == 0
    packed = writers.package_documents(r.filter("location = 'head' and sample_id = 's2'")).first()
    assert json.loads(packed.document)["atomic_rules"][0] == {"id": "Hair Color", "location": "head", "value": "3"}


def test_elements_registry_and_runs(spark, tmp_path):
    (tmp_path / "cat" / "s1").mkdir(parents=True)
    (tmp_path / "cat" / "s1" / "e.json").write_text(json.dumps({"elements": [{"name": "a", "value:": "v", "attributes": {"color": "red"}}, {"name": "a", "value": "v"}, {"name": "b"}]}))
    e = documents.elements(documents.read_documents(spark, f"{tmp_path}/*/*/e.json"), dedupe=True)
    assert sorted((r.name, r.value, r.color) for r in e.collect()) == [("a", "v", "red"), ("b", "", "")]
    (tmp_path / "c1.json").write_text(json.dumps({"samples": [{"sample_id": "s1", "category": "cat", "atomic_rules": "x/s1/rules.json"}]}))
    (tmp_path / "c2.json").write_text(json.dumps([{"sample_id": "s2"}]))
    c = documents.read_documents(spark, f"{tmp_path}/c*.json")
    assert sorted(r.sample_id for r in documents.registry(c).collect()) == ["s1", "s2"]
    assert [r.sample_id for r in documents.registry(c, wrapped_only=True).collect()] == ["s1"]
    rule_rows = spark.createDataFrame([("/data/s1/rules.json", "hair", "red")], "path string, rule_id string, value string")
    assert [(r.sample_id, r.rule_id) for r in documents.registered_rules(documents.registry(c), rule_rows).collect()] == [("s1", "hair")]
    (tmp_path / "cat" / "s1" / "summary.json").write_text(json.dumps({"rule_count": 4, "qc_counts": {"PASS": 3}}))
    (tmp_path / "cat" / "s2").mkdir()
    (tmp_path / "cat" / "s2" / "summary.json").write_text("?")
    runs = documents.prediction_runs(documents.read_documents(spark, f"{tmp_path}/*/*/summary.json")).collect()
    assert [(r.category, r.sample_id, r.rules, r.qc_pass, r.qc_fail) for r in runs] == [("cat", "s1", 4, 3, 0)]


def test_workbooks(spark, tmp_path):
    rows = [["sample_id", " rule_id ", "front_visible", "front_status", "side_visible", "side_status", "back_visible", "back_status", "result", "value"], ["s1", "hair", "visible", "correct", "visible", "wrong color", "invisible", "correct", "wrong", "red & <b>"], ["", "", ""], ["s1", "coat"]]
    content = workbooks.build(rows, {3: ["correct", "wrong color"]})
    assert workbooks.parse(content)[:2] == rows[:2]
    assert [workbooks.column_index(x) for x in ("A", "Z", "AA", "AB", "AZ", "BA")] == [0, 25, 26, 27, 51, 52]
    assert [workbooks.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    folder = tmp_path / "plush" / "s1"
    folder.mkdir(parents=True)
    (folder / "a.xlsx").write_bytes(content)
    (folder / "~$a.xlsx").write_bytes(b"lock")
    found = workbooks.records(workbooks.read_cells(spark, str(tmp_path)))
    assert sorted((r.source_row, r.record["rule_id"], r.record["value"]) for r in found.collect()) == [(2, "hair", "red & <b>"), (4, "coat", "")]
    assert found.select(workbooks.schema_guess(F.col("header")), workbooks.view_schema(F.col("header"))).first()[:] == ("v3_rule_level", "v3_visible_status")
    guess = lambda *h: spark.range(1).select(workbooks.schema_guess(F.array(*map(F.lit, h)))).first()[0]
    assert guess("finding_id", "view", "element_name") == "human_visual_findings" and guess("rule_id", "rule_validity", "atomic_value") == "atomic_rule_audit"
    assert guess("human_finding_id", "atomic_rule_id", "candidate_match_type") == "human_to_atomic_rule_mapping" and guess("x") == "unknown"
    built = products.build(spark, str(tmp_path))
    assert sorted((r.rule_id, r.qc_status) for r in built["report"].collect()) == [("coat", "FAIL"), ("hair", "PASS")]
    s = built["summary"].first()
    assert (s.category, s.sample_id, s.rule_rows, s.wrong_rows, s.qc_pass_rows, s.qc_fail_rows) == ("plush", "s1", 2, 1, 1, 1)
    again = workbooks.to_workbooks(spark.createDataFrame([("s1", 2, "b"), ("s1", 1, "a"), ("s2", 1, "c")], "s string, k int, v string"), ["s"], ["k", "v"], ["k"])
    assert {r.s: workbooks.parse(bytes(r.content)) for r in again.collect()} == {"s1": [["k", "v"], ["1", "a"], ["2", "b"]], "s2": [["k", "v"], ["1", "c"]]}


def test_layout(spark, tmp_path):
    for p in ("cat/s1/out.png", "cat/s1/out.jpg", "cat/s2_x/in.jpg", "cat/s2_x/~$in.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    files = layout.list_files(spark, str(tmp_path)).withColumn("sample_id", F.col("parent"))
    assert sorted((r.grandparent, r.parent, r.stem, r.prefix) for r in files.collect()) == [("cat", "s1", "out", "out"), ("cat", "s1", "out", "out"), ("cat", "s2_x", "in", "in")]
    assert {r.sample_id: r["name"] for r in layout.one_per(files, "sample_id").collect()} == {"s1": "out.jpg", "s2_x": "in.jpg"}
    best = layout.best_place(files, "sample_id", (r"/out\.png$", r"\.jpg$"))
    assert {r.sample_id: (r.path.split("/")[-1], r.place) for r in best.collect()} == {"s1": ("out.png", 0), "s2_x": ("in.jpg", 1)}
    have = layout.presence(spark.createDataFrame([("s1",), ("s9",)], "sample_id string"), files, "sample_id", {"png": r"\.png$", "webp": r"\.webp$"})
    assert {r.sample_id: (r.png, r.webp) for r in have.collect()} == {"s1": (True, False), "s9": (False, False)}


def test_paged_source(spark, tmp_path):
    for k, data in enumerate(('[{"id": 1}, {"id": 2}, 5]', '{"post": [{"id": 3}]}', "")):
        (tmp_path / f"{k}.json").write_text(data)
    spark.dataSource.register(pages.PagedSource)
    rows = spark.read.format("paged").options(location=str(tmp_path), pages=3, fetcher="sparloom.sources.pages:read_file").load().collect()
    assert sorted((r.page, r.position, r.post_id) for r in rows) == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3")]
    assert pages.posts_of('{"id": 9}') == [] and pages.posts_of("[]") == []


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("b", "1", "x"), ("a", "2", None)], "primary_category string, sample_id string, extra string")
    writers.write_csv(d, str(tmp_path / "csv"), ["sample_id", "primary_category", "more"], for_excel=True)
    back = tables.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns[:3] == ["sample_id", "primary_category", "more"] and sorted(r.sample_id for r in back.collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        writers.write_csv(d, str(tmp_path / "strict"), ["sample_id"], strict=True)
    writers.write_json(d, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    writers.write_queues(d, str(tmp_path / "queues"))
    assert {r.primary_category: r.value for r in spark.read.text(str(tmp_path / "queues")).collect()} == {"a": "2", "b": "1"}
    writers.write_by(d, str(tmp_path / "by"), ["primary_category"])
    assert (tmp_path / "by" / "primary_category=a").is_dir()
    assert writers.ragged_union(d, spark.createDataFrame([("z",)], "other string")).columns == ["primary_category", "sample_id", "extra", "other"]
    assert json.loads(writers.report(d.filter("sample_id = '2'")).first().report)["extra"] is None
    assert [r.sample_id for r in writers.ordered_report(d, [F.desc("sample_id")], 1).collect()] == ["2"]
