"""Spans that no base pattern finds: proposed by the generators and selected by the trees."""

from pyspark.sql import functions as F

from sparloom.llm import pii

PLANTED = ["(743) 555-3824", "743-555-3824", "jane.doe (at) example.org", "sales[at]example.com", "378282246310005", "3714 496353 98431", "4222222222222", "30569309025904"]
CLEAN = ["2019-10-12", "12.05.2021", "1939 - 1945", "12.500.000", "meet (at) noon", "378282246310006", "4222222222223", "1700000000008", "300.400.500.600", "1234 5678 9012"]


def test_other_forms_are_selected(spark, documents):
    rows = [(10_000 + k, f"we wrote {v} and left") for k, v in enumerate(PLANTED)] + [(20_000 + k, f"we wrote {v} and left") for k, v in enumerate(CLEAN)]
    rows += [(30_000, "card 6011000000000 here"), (30_001, "phone: 020 7946 0958 today")]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (documents.select("doc_id", "text").union(planted), planted):
        got = {r.doc_id: [(s.start, s.end, s.base) for s in r.found] for r in pii.find(d).filter("doc_id >= 10000").collect()}
        for k, v in enumerate(PLANTED):
            assert got[10_000 + k] == [(9, 9 + len(v), False)], v
        for k, v in enumerate(CLEAN):
            assert not got[20_000 + k], v
        assert got[30_001] == [(7, 20, False)]


def test_other_forms_are_redacted(spark):
    d = spark.createDataFrame([(1, "we wrote (743) 555-3824 and jane.doe (at) example.org, 378282246310005.")], "doc_id long, text string")
    assert pii.redact(d).first().text == "we wrote <phone> and <email>, <card>."


def test_labels_are_no_features():
    assert not {"loose", "plus", "parts"} & set(pii.FEATURES)


def test_no_span_is_added_to_given_texts(spark, documents):
    assert pii.find(documents).filter(F.exists("found", lambda s: ~s["base"])).count() == 0


def test_precision_and_recall_on_texts_of_another_seed(spark, documents):
    """Made texts that the trees have not seen: a text counts as found if a span of its kind is added."""
    made = pii.examples(150, seed=2024)
    d = spark.createDataFrame([(1_000_000 + k, text) for k, (text, _, _) in enumerate(made)], "doc_id long, text string")
    found = pii.find(documents.select("doc_id", "text").union(d)).filter("doc_id >= 1000000")
    kinds = {r.doc_id - 1_000_000: {s.kind for s in r.found if not s.base} for r in found.collect()}
    told = [(kind in kinds[k], label) for k, (_, kind, label) in enumerate(made)]
    hit = sum(yes and label for yes, label in told)
    assert hit / sum(yes for yes, _ in told) >= 0.9
    assert hit / sum(label for _, label in told) >= 0.9


def test_thresholds_are_there(spark, documents):
    own = pii.find(documents)  # the model of the given texts alone
    assert own.count() == documents.count()
    candidates = documents.select(F.xxhash64("text").alias("h"), pii.candidates(F.col("text")).alias("c"))
    assert set(pii.fit_model(candidates, "c", "h")) >= {0, 2, 3}
