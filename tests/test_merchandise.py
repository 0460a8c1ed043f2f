from pyspark.sql import functions as F

from sparloom.functions.parsing import position_value
from sparloom.plans import merchandise


def test_assignment_plan(spark):
    images = spark.createDataFrame([(f"s{k:02d}", f"/img/s{k:02d}.png") for k in range(12)], "sample_id string, path string")
    manifest = spark.createDataFrame([(f"s{k:02d}", "full_body looking_at_viewer standing" if k % 2 else "hat white_background", "" if k else "/own.png") for k in range(10)], "post_id string, tags string, image_path string")
    generated = spark.createDataFrame([("s01", "cake_roll"), ("s03", "cake_roll")], "sample_id string, category string")
    d = merchandise.enriched(images, manifest, generated)
    assert {r.sample_id: r.image_path for r in d.collect()}["s00"] == "/own.png" and d.filter("image_path = ''").count() == 0
    even = merchandise.assigned(d, balanced=True)
    assert {r.primary_category: r.total for r in merchandise.summary(even).collect()} == dict.fromkeys(merchandise.V.CATEGORIES, 2)
    assert {r.primary_category: r.remaining for r in merchandise.summary(even).collect()}["cake_roll"] == 0
    assert all(len(r.candidate_categories.split("|")) <= 4 and r.primary_category in r.candidate_categories.split("|") for r in even.collect())
    free = {r.sample_id: r for r in merchandise.assigned(d).collect()}
    assert (free["s01"].primary_category, free["s01"].assignment_source) == ("cake_roll", "existing_generated_output") and free["s01"].candidate_categories.startswith("cake_roll|")
    assert free["s02"].assignment_source == "rule_score" and free["s02"].primary_score == free["s02"].score_cake_roll
    rows = even.orderBy(*merchandise.review_order(even)).collect()
    assert [r.primary_category for r in rows] == sorted(r.primary_category for r in rows)


def test_packages(spark):
    a = spark.createDataFrame([("s1", "c", ""), ("s2", "c", "x")], "sample_id string, category string, label string")
    m = spark.createDataFrame([("s1", "from manifest", "9"), ("s2", "y", "8")], "post_id string, label string, width string")
    full = {r.sample_id: (r.label, r.width) for r in merchandise.with_manifest(a, m).collect()}
    assert full == {"s1": ("from manifest", "9"), "s2": ("x", "8")}
    files = spark.createDataFrame([("s1", "/d/s1.jpg"), ("s1", "/d/s1.png"), ("s1", "/d/s1.xlsx"), ("s2", "/d/s2.png")], "sample_id string, path string")
    rows, counts = merchandise.packages(a, files, {"image": (r"\.png$", r"\.jpg$"), "sheet": (r"\.xlsx$",)})
    assert {r.sample_id: (r.image, r.sheet) for r in rows.collect()} == {"s1": ("/d/s1.png", "/d/s1.xlsx"), "s2": ("/d/s2.png", None)}
    c = counts.first()
    assert (c.assignments, c.with_image, c.with_sheet, c.packaged, c.missing) == (2, 2, 1, 1, 1)


def test_sides_stay(spark):
    assert spark.range(1).select(position_value(F.lit("left side"))).first()[0] == "left side"
