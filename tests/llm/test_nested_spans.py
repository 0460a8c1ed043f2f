"""Redaction of spans inside others."""

from sparloom.llm import pii


def test_spans_after_a_nested_one_stay_inside(spark):
    d = spark.createDataFrame([(1, "x.1.2.3.4.5.6.7.8@x.com"), (2, "see x.1.2.3.4.5.6.7.8@x.com, 1.2.3.4 and a@b.co")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert got == {1: "<email>", 2: "see <email>, <ip> and <email>"}
