"""Nested features to any depth and colour families, against plain recursion and a plain loop."""

import json
import random
import time

from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions import colors
from sparloom.plans import extraction


def as_text(value):
    empty = (None, "", [], {})
    if isinstance(value, dict):
        return "；".join(f"{k}: {as_text(x)}" for k, x in sorted(value.items()) if x not in empty)
    if isinstance(value, list):
        return "；".join(as_text(x) for x in value if x not in empty)
    return "" if value is None else str(value).strip()


def made(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["a", " b ", "", "x [1] {y", 'q"\\"]', 7, None])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: made(rng, depth - 1) for k in rng.sample("abcde", rng.randrange(4))}


def values(spark, answers):
    d = spark.createDataFrame(list(enumerate(answers)), "sample_id long, answer string")
    return {(r.sample_id, r.name): r.value for r in extraction.elements(d).collect()}


def test_random_values(spark):
    rng = random.Random(5)
    features = [{f"f{k}": made(rng, 7) for k in range(3)} for _ in range(120)]
    want = {(i, k): as_text(x) or k for i, f in enumerate(features) for k, x in f.items()}
    assert values(spark, [json.dumps({"identity_features": f}) for f in features]) == want


def test_two_hundred_levels(spark):
    value, want = "end", "end"
    for k in range(200):
        value, want = ({"k": value}, f"k: {want}") if k % 2 else ([value, ""], want)
    began = time.time()
    assert values(spark, [json.dumps({"identity_features": {"f": value}})]) == {(0, "f"): want}
    assert time.time() - began < 60


def test_rows_without_features(spark):
    assert values(spark, [None, "", "no", "{}", '{"identity_features": 3}', '{"identity_features": {}}', '{"elements": [], "identity_features": {"a": "b"}}']) == {}
    assert values(spark, ['{"elements": [{"name": "hat"}, {}, {"value": "red"}]}']) == {(0, "hat"): "hat", (0, "red"): "red"}


def families(text):
    low, found = (text or "").lower(), set()
    for word, family in sorted(((w.lower(), f) for f, ws in V.COLOR_ALIASES.items() for w in ws), key=lambda x: -len(x[0])):
        if word in low:
            low = low.replace(word, "\0" * len(word), 1)
            found.add(family)
    return sorted(found)


def test_families_of_random_texts(spark):
    rng = random.Random(6)
    words = [w for ws in V.COLOR_ALIASES.values() for w in ws]
    texts = [None, "", "RED Red red", *("".join(rng.choice([*words, " ", "x", "深", "浅", "😀"]) for _ in range(rng.randrange(1, 12))) for _ in range(400))]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", colors.color_families("t").alias("f"))
    assert {r.i: r.f for r in got.collect()} == {i: families(t) for i, t in enumerate(texts)}


def test_families_stay_in_the_jvm(spark):
    plan = spark.range(3).select(colors.color_families(F.col("id").cast("string")).alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
