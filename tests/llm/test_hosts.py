"""Verdicts on hosts: by their shrunk rates, in operator and SQL alike."""

import duckdb
import pytest

from sparloom.llm import quality_rules

GOOD = "the quick brown fox jumps over a lazy dog and runs home to sleep until noon {}"
BAD = "buy this # now $ or * never % see & more | today < and > again # or so {}"


def documents():
    rows, k = [], 0
    for host in range(30):
        for n in range(40):
            rows.append((k, (BAD if n == 0 else GOOD).format(k), f"host{host}"))
            k += 1
    for n in range(40):  # a large host of bad documents and some good ones
        rows.append((k, (GOOD if n % 10 == 0 else BAD).format(k), "large"))
        k += 1
    for n in range(2):  # a small one of the same raw rate, and of one good document
        rows.append((k, BAD.format(k), "small"))
        k += 1
    rows.append((k, GOOD.format(k), "small"))
    rows += [(k + 1, GOOD.format(k), None), (k + 2, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), "doc_id long, text string, source string")


def test_a_large_bad_host_goes_and_a_small_one_stays(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, text, host in documents():
        r = got[i]
        assert r.host_ok == (host != "large"), host
        assert r.doc_ok == (text is not None and text.startswith("the quick"))
        assert r.kept == (r.doc_ok and host != "large")
    kept = {r.doc_id for r in quality_rules.keep_documents(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_limits_are_parameters(docs):
    assert quality_rules.judge(docs, min_rate=0.99, max_rate=0.99).filter("not host_ok").count() == 0


def test_sql_gives_the_same_verdicts(docs, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(quality_rules.OP5_SQL)
    spark_rows = quality_rules.op5_quality_rules(docs.sparkSession, str(tmp_path))
    columns = sorted(want.columns)
    rows = lambda data, cols: sorted(repr([r[cols.index(c)] for c in columns]) for r in data)
    assert rows(spark_rows.collect(), spark_rows.columns) == rows(want.fetchall(), want.columns)
