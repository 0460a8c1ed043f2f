"""Tables that grow with the input are not broadcast where Spark sizes them too low, as after an explode."""

from pyspark.sql import functions as F

from sparloom.llm import components, mixing, similar_sets, simhash


def sent(plan):
    """What a physical plan broadcasts: the texts of the trees below its broadcasts."""
    lines = [(len(x) - len(x.lstrip(" :+-*0123456789()")), x) for x in plan.split("\n")]
    trees = []
    for k, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if lines[j][0] <= depth), len(lines))
            trees.append("\n".join(x for _, x in lines[k:end]))
    return trees


def watch(monkeypatch, *modules):
    """The plans of the tables that ``modules`` write, as (label, plan)."""
    plans = []
    for module in modules:
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, write=write: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    return plans


def test_exploded_keys_of_fingerprints_are_shuffled(spark, monkeypatch):
    plans = watch(monkeypatch, simhash, components)
    # each is two bits from the one before it, so some stay apart until members of a bucket are compared
    near = [0, 3, 15, 63, 255]
    fps = spark.createDataFrame([(x,) for x in near], "fp long").union(spark.range(1000, 1010).select((F.col("id") * 0x5DEECE66D).alias("fp")))
    roots = {r.a: r.b for r in simhash.link(fps).collect()}
    assert [roots.get(x) for x in near] == [None, 0, 0, 0, 0]
    assert any("Generate" in plan for label, plan in plans if label == "simhash-buckets") and any("Generate" in plan for label, plan in plans if label == "edges")
    assert not [label for label, plan in plans for tree in sent(plan) if "Generate" in tree]


def test_buckets_and_texts_are_shuffled(spark, monkeypatch):
    w = [f"w{k}" for k in range(300)]
    texts = [" ".join(w[8 * k : 8 * k + 100]) for k in range(12)]
    plans = watch(monkeypatch, similar_sets)
    docs = spark.createDataFrame([(str(k), k, t) for k, t in enumerate(texts)], "key string, doc_id long, text string")
    assert len({r.root for r in similar_sets.groups(docs).collect()}) == 1
    found = {label: plan for label, plan in plans if label in ("sets-pairs", "sets-links")}
    assert not [tree for tree in sent(found["sets-pairs"]) if "y_c#" in tree.split("\n")[1]]
    assert not [tree for tree in sent(found["sets-links"]) if "_text#" in tree.split("\n")[1]]


def test_places_of_salts_are_shuffled(spark):
    docs = spark.createDataFrame([(k, "some words " * (k % 7), f"s{k % 3}") for k in range(40)], "doc_id long, text string, source string")
    trees = sent(mixing.mix(docs)._jdf.queryExecution().executedPlan().toString())
    assert trees and not [tree for tree in trees if "salt#" in tree.split("\n")[0] + tree.split("\n")[1]]
