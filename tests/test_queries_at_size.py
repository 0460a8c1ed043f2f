"""Queries on rows that the smallest tables do not hold, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


def tables(spark, tmp_path, **rows):
    """Parquet tables of (schema, rows) below a folder, and a DuckDB connection that has them as views."""
    con = duckdb.connect()
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    return con


def same(spark, tmp_path, con, name):
    want, got = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, str(tmp_path))
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    found = sorted(repr(tuple(r)) for r in got.select(*cols).collect())
    assert found == sorted(repr(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall()) and found
    return found


def test_levels_are_single_precision(spark, tmp_path):
    """0.96 as a single-precision number is 0.95999998: times 800, 768 in single precision and 767.99998 in double."""
    near = [0.9599999785423279, 0.7674999833106995, 0.7799999713897705, -0.5]
    vectors = [(k, [near[(i * (k + 3) + k) % 4] for i in range(64)]) for k in range(8)]
    con = tables(spark, tmp_path, embeddings=("vec_id long, embedding array<float>", vectors))
    same(spark, tmp_path, con, "color_metrics")


def test_data_url_is_one_line(spark, tmp_path):
    con = tables(spark, tmp_path, pages=("page_id long, url string", [(k, "https://example.org/" + "é" * k * 7) for k in range(12)]))
    assert not any("\\n" in r or "\\r" in r for r in same(spark, tmp_path, con, "data_urls"))


def test_gradients_are_single_precision(spark, tmp_path):
    """A pixel of 156 in single precision and 155 in double, beside pixels of just as much."""
    near = [0.559999942779541, 0.555, 0.9199999570846558, 0.915, 0.4099999666213989, 0.405, -0.2]
    vectors = [(k, [near[(i * (k + 1) + k) % 7] for i in range(64)]) for k in range(6)]
    con = tables(spark, tmp_path, embeddings=("vec_id long, embedding array<float>", vectors))
    same(spark, tmp_path, con, "gradient_hashes")


def test_copies_are_turned_at_bits_of_their_vector(spark, tmp_path):
    """A vector that differs from a copy's sign bits, as the old number says which are turned, in one bit."""
    turned = lambda k: {(k + 9 * j) % 64 for j in range(k % 8)}
    base = [(k, [1.0 if (i * 7 + k * 13) % 5 < 2 else -1.0 for i in range(64)]) for k in range(3, 8)]
    close = [(100 * k, [-x if (i in turned(k)) != (i == 50) else x for i, x in enumerate(v)]) for k, v in base]
    con = tables(spark, tmp_path, embeddings=("vec_id long, embedding array<float>", base + close))
    same(spark, tmp_path, con, "hamming_pairs")


def test_widths_beyond_16_bits(spark, tmp_path):
    con = tables(spark, tmp_path, events=("event_id long, user_id long", [(k, u) for k, u in enumerate([0, 7, 65533, 65533, 65534, 65534, 65535, 65535, 90_000, 90_001])]))
    same(spark, tmp_path, con, "image_sizes")


def test_equal_findings_are_scored_once(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from sparloom.operators import alignment

    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def same_text(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return (a == b).astype(float)

    findings = spark.createDataFrame([(k, "s", f"f{k}", "red hat") for k in range(40)], "_row long, sample_id string, finding_id string, human_rule_name string")
    rules = spark.createDataFrame([("", "s", 1, "red", "hat"), ("", "s", 2, "blue", "hat")], "category string, sample_id string, position int, rule_id string, value string")
    found, _ = alignment.align(findings, rules, scorer=same_text)
    assert sorted((r._row, r["rank"], r.atomic_rule_id, r.human_finding_id) for r in found.collect()) == [(k, n, x, f"f{k}") for k in range(40) for n, x in ((1, "red"), (2, "blue"))]
    assert 2 <= scored.value <= 8


def test_equal_pairs_of_elements_are_scored_once(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from sparloom.operators import coverage

    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def nothing(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series([0.0] * len(a))

    names = "sample_id string, index int, name string"
    blank = [F.lit("").alias(c) for c in coverage.FIELDS[1:]]
    gold, pred = (spark.createDataFrame([(f"s{k}", n, name) for k in range(30)], names).select("*", *blank) for n, name in ((1, "红色外套"), (2, "外套")))
    found = coverage.audit_gold(gold, pred, scorer=nothing).collect()
    assert len(found) == 30 and all(r.covered and r.covering == [2] for r in found)
    assert 1 <= scored.value <= 4


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_split_once_a_row(spark, sf):
    assert "array_contains(array_distinct" not in plan(entry.queries()["key_tags"](spark, sf))


def test_gates_are_applied_once(spark, tmp_path, monkeypatch):
    import pandas as pd
    from pyspark.sql import functions as F

    from sparloom.streaming import posts

    passed, gates = spark.sparkContext.accumulator(0), posts.cascade

    @F.pandas_udf("string")
    def counted(x: pd.Series) -> pd.Series:
        passed.add(len(x))
        return x

    monkeypatch.setattr(posts, "cascade", lambda batch: gates(batch.withColumn("rating", counted("rating"))))
    sized = [F.lit("900").alias(c) for c in ("sample_width", "sample_height", "width", "height")]
    rows = spark.range(60).coalesce(1).select(F.floor(F.col("id") / 2).alias("id"), F.concat(F.lit("1girl solo multiple_views turnaround t"), F.col("id").cast("string")).alias("tags"), F.lit("safe").alias("rating"), *sized, *[F.lit("").alias(c) for c in ("source", "crawl_label", "raw_tags")], F.col("id").alias("order"))
    posts.accept_posts(f"{tmp_path}/out")(rows, 0)
    assert sorted(r.order for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(0, 60, 2))
    assert passed.value == 60


def test_batches_of_pages_grow(tmp_path, monkeypatch):
    from sparloom.sources import pages

    for page in range(101):
        (tmp_path / f"{page}.json").write_text('[{"id": 1}, {"id": 2}]' if page < 100 else "[]")
    monkeypatch.setattr(pages, "BATCH_POSTS", 40)
    reader = pages.PagedStreamReader({"location": str(tmp_path), "fetcher": "sparloom.sources.pages:read_file", "pages_per_batch": "2"})
    at, sizes = reader.initialOffset(), []
    while (end := reader.read(at)[1]) != at:
        assert len(list(reader.readBetweenOffsets(at, end))) == 2 * (end["page"] - at["page"])
        sizes.append(end["page"] - at["page"])
        at = end
    assert sizes == [2, 4, 8, *[16] * 5, 6]


def test_checked_rows_are_shuffled_narrow(spark, sf):
    """Above the joins stand lists of codes, not the columns they were made of; places take no second shuffle."""
    from pyspark.sql import functions as F

    from sparloom.operators import basics

    for name, own in (("gold_row_checks", "front_visible"), ("audit_row_checks", "corrected_value"), ("finding_row_checks", "match_status"), ("legacy_checks_by_sample", "reason")):
        above = plan(entry.queries()[name](spark, sf)).split("Join LeftOuter")[0]
        assert f"{own}#" not in above, name
    assert "windowspecdefinition(_part" not in plan(basics.global_place(spark.range(9), [F.col("id")]))


def test_colours_are_sought_once_and_where_asked(spark, sf):
    text = plan(entry.queries()["wrong_by_issue"](spark, sf))
    assert "overlay(" in text and not any("overlay(" in line for line in text.split("\n") if "Filter" in line)


def test_workbooks_are_read_and_written_row_by_row():
    from sparloom.sources import workbooks

    rows = [["a", "b"], *[[f"<{k}>", "" if k % 3 else "é"] for k in range(3000)]]
    left = iter(rows)
    content = workbooks.build(left, {1: ["x"]})
    assert workbooks.parse(content) == rows and len(content) < 100_000
    assert next(workbooks.parsed_rows(content)) == ["a", "b"]
