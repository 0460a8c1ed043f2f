"""Samples to product categories: images with their manifest rows and what is generated already, scored and
assigned, with queues and a summary; and packages of an assignment's assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.text import first_filled
from sparloom.operators import basics, scoring


def enriched(images: DataFrame, manifest: DataFrame, generated: DataFrame) -> DataFrame:
    """Images (sample_id, path) with the manifest's columns (key post_id) and already_generated_category; the
    manifest's image path stands before the file's."""
    m = manifest.withColumnRenamed("post_id", "sample_id")
    d = images.select("sample_id", F.col("path").alias("_found")).join(m, "sample_id", "left")
    path = first_filled(F.col("image_path") if "image_path" in m.columns else F.lit(""), F.col("_found"))
    done = generated.select("sample_id", F.col("category").alias("already_generated_category"))
    return d.withColumn("image_path", path).drop("_found").join(done, "sample_id", "left").fillna("", ["already_generated_category"])


def assigned(samples: DataFrame, balanced: bool = False) -> DataFrame:
    """Samples with scores, primary_category (what is generated already, else the best, or the one that the quotas
    leave), assignment_source and candidate_categories. Unbalanced, a category that is no candidate comes
    before the candidates, so there may be five; balanced lists are cut to four."""
    d = scoring.assign(scoring.score(samples))
    given = F.nullif(F.col("already_generated_category"), F.lit(""))
    if balanced:
        d = d.join(scoring.balanced(d), "sample_id")
        primary, source = F.col("assigned"), F.when(given.isNotNull(), "existing_generated_output").otherwise("balanced_score")
    else:
        primary, source = F.coalesce(given, F.col("primary_category")), F.when(given.isNotNull(), "existing_generated_output").otherwise("rule_score")
    listed = F.split("candidate_categories", r"\|")
    joined = F.when(F.array_contains(listed, primary), listed).otherwise(F.concat(F.array(primary), listed))
    points = F.coalesce(*[F.when(primary == c, F.col(f"score_{c}")) for c in V.CATEGORIES])
    out = d.withColumns({"_p": primary, "_s": source, "_c": F.array_join(F.slice(joined, 1, 4) if balanced else joined, "|"), "_n": points})
    return out.withColumns({"primary_category": F.col("_p"), "assignment_source": F.col("_s"), "candidate_categories": F.col("_c"), "primary_score": F.col("_n")}).drop("_p", "_s", "_c", "_n", "assigned")


def review_order(rows: DataFrame) -> list:
    return [F.col("primary_category"), F.desc("primary_score"), F.col("sample_id")]


def summary(rows: DataFrame) -> DataFrame:
    """Per category, also empty ones: samples, those generated already, those left."""
    dimension = rows.sparkSession.createDataFrame([(c,) for c in V.CATEGORIES], "primary_category string")
    done = F.col("already_generated_category") != ""
    return basics.summary_over(rows, dimension, "primary_category", total=F.lit(True), already_generated=done, remaining=~done)


def with_manifest(assignments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Assignments with the manifest's columns where their own are blank."""
    m = manifest.withColumnRenamed("post_id", "sample_id")
    both = [c for c in assignments.columns if c in m.columns and c != "sample_id"]
    d = assignments.join(m.select("sample_id", *[F.col(c).alias(f"_m_{c}") for c in m.columns if c != "sample_id"]), "sample_id", "left")
    own = [first_filled(F.col(c), F.col(f"_m_{c}")).alias(c) if c in both else F.col(c) for c in assignments.columns]
    more = [F.coalesce(F.col(f"_m_{c}").cast("string"), F.lit("")).alias(c) for c in m.columns if c not in assignments.columns and c != "sample_id"]
    return d.select(*own, *more)


def packages(assignments: DataFrame, files: DataFrame, assets: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """(rows, summary): for each assignment the path of every asset, by the first of its patterns that a file of
    the sample fits, or null; and how many have each, and how many lack one. Copying is for the caller."""
    from sparloom.sources.layout import best_place

    d = assignments
    for name, patterns in assets.items():
        d = d.join(best_place(files, "sample_id", patterns).select("sample_id", F.col("path").alias(name)), "sample_id", "left")
    lacking = F.greatest(*[F.col(a).isNull() for a in assets]) if len(assets) > 1 else F.col(next(iter(assets))).isNull()
    counts = d.agg(F.count("*").alias("assignments"), *[F.count(a).alias(f"with_{a}") for a in assets], F.count_if(~lacking).alias("packaged"), F.count_if(lacking).alias("missing"))
    return d, counts
