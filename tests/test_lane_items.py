"""Issues and notes in rows are those of the review's arrays, on random rules, and are found without lambdas over rules."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparloom.operators import lanes

STATUSES = ["correct", "wrong_color", "wrong color", " wrong shape\n", "wrong", "extra", "　extra", "ambiguous", "wrong_invisible", "", None]
ISSUES = ["none", "paired_box_completion", "other", "wrong_material", " extra ", "missing", "", None]
NOTES = [None, [], [("front", "f"), ("overall", None), (None, "n")], [("side", "s")], [("overall", "o")]]


def rule(rng):
    views = [x for _ in range(3) for x in ("visible", rng.choice(STATUSES if rng.random() < 0.5 else ["correct"]))]
    return ("r%d" % rng.randrange(9), "v", *views, rng.choice(["correct", "wrong", "unsure", None]), rng.choice(ISSUES), rng.choice(["Very_High", "0.42", "7", " low ", "odd", None]), rng.choice(["", " why\t", None]), rng.choice(NOTES))


def test_same_as_review(spark):
    rng = random.Random(7)
    rows = [(k, None if k % 50 == 7 else [None if rng.random() < 0.02 else rule(rng) for _ in range(rng.randrange(5))]) for k in range(400)]
    d = spark.createDataFrame(rows, f"k int, rules array<{lanes.RULE}>")
    review = lanes.review(d.withColumn("rules", lanes.normalized(F.col("rules"))))
    want = review.select("k", F.explode(F.concat("billable_issues", "design_notes")).alias("i")).select("k", "i.*")
    got = lanes.lane_items(d)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 300
    assert {r.view for r in got.collect()} == {"front", "side", "back", "overall"} and {r.lane for r in got.collect()} == {"billable", "design"}


def test_no_lambdas_over_rules(spark, sf):
    plan = entry.queries()["review_lanes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(rules" not in plan and "flatten" not in plan and "size(array(" not in plan
