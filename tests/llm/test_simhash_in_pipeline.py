"""The pipeline's near-duplicate stage takes candidates from fingerprints, and checks them."""

from sparloom.llm import similar_sets, simhash


def test_linked_fingerprints_are_candidates(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), "a few other words", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, groups = [], similar_sets.groups
    monkeypatch.setattr(similar_sets, "groups", lambda *a, near, **k: asked.append(near) or groups(*a, near=near, **k))
    kept = simhash.keep_similar_once(docs)
    hashes = [r.h for r in docs.selectExpr("xxhash64(text) AS h").collect()]
    assert {frozenset(r) for r in asked[0].collect()} == {frozenset(hashes[:2])}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


def test_candidates_are_checked(spark):
    """A candidate that is not similar links nothing; one that is, links."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:30], *reversed(words[30:])])]
    docs = spark.createDataFrame([(str(k), k, t) for k, t in enumerate(texts)], "key string, doc_id long, text string")
    h = [r.h for r in docs.selectExpr("xxhash64(text) AS h").collect()]
    near = spark.createDataFrame([(h[1], h[0]), (h[2], h[0]), (h[2], h[1])], "x_th long, y_th long")
    roots = {r.doc_id: r.root for r in similar_sets.groups(docs, near=near).collect()}
    assert roots[0] == roots[1] != roots[2]
