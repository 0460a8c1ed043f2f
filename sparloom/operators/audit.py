"""Structural audit of a dataset of sample documents and images, and the check of a smoke set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions.text import stripped


ISSUE = "array<struct<severity:string,code:string,path:string,message:string>>"


def _issue(severity: str, code: str, when: Column, message: Column, path: Column) -> Column:
    """The issue as a struct, or null."""
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"), message.alias("message")))


def _found(df: DataFrame, *issues: Column) -> DataFrame:
    return df.select(F.inline(F.array_compact(F.array(*issues))))


def audit(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (severity, code, path, message). ``documents``: (path, v) with v a VARIANT or null; ``images``: (path,
    sha256, width, height), sha256 null where the file could not be read, width null where the header tells none.
    A source image is relative to its document. What a document alone shows comes out of one pass over it."""
    here = F.col("path")
    text = lambda c, p: stripped(F.coalesce(F.try_variant_get(c, p, "string"), F.lit("")))
    is_object = lambda c: F.coalesce(F.startswith(F.call_function("schema_of_variant", c), F.lit("OBJECT")), F.lit(False))
    source = text("v", "$.source_image")
    d = documents.select("path", "v", is_object(F.col("v")).alias("ok"), text("v", "$.sample_id").alias("sample_id"), source.alias("source"), F.try_variant_get("v", "$.elements", "array<variant>").alias("elements"))
    folder, absolute = F.regexp_replace("path", r"/[^/]*$", ""), F.startswith("source", F.lit("/"))
    d = d.withColumn("image", F.when(F.col("ok") & (F.col("source") != ""), F.when(absolute, F.col("source")).otherwise(F.concat(folder, F.lit("/"), F.regexp_replace("source", r"^\./", "")))))
    element = F.transform(F.coalesce("elements", F.array().cast("array<variant>")), lambda e, k: F.struct(k.alias("k"), is_object(e).alias("ok"), text(e, "$.name").alias("name"), text(e, "$.value").alias("value")))

    def of_element(e: Column) -> Column:
        say = lambda form: F.format_string(form, e["k"])
        return F.array(_issue("error", "invalid_element", ~e["ok"], say("elements[%d] must be an object"), here), _issue("error", "invalid_element_name", e["ok"] & (e["name"] == ""), say("elements[%d].name is empty"), here), _issue("error", "invalid_element_value", e["ok"] & (e["name"] != "") & (e["value"] == ""), say("elements[%d].value is empty"), here))

    names = F.transform(F.filter("e", lambda e: e["ok"] & (e["name"] != "") & (e["value"] != "")), lambda e: e["name"])
    repeated = F.array_sort(F.array_distinct(F.filter("names", lambda n: F.size(F.filter("names", lambda m: m == n)) > 1)))
    own = d.withColumn("e", element).withColumn("names", names).withColumn("repeated", repeated)
    alone = [
        _issue("error", "invalid_json", F.col("v").isNull(), F.lit("not JSON"), here),
        _issue("error", "invalid_root", F.col("v").isNotNull() & ~F.col("ok"), F.lit("JSON root must be an object"), here),
        _issue("error", "invalid_sample_id", F.col("ok") & (F.col("sample_id") == ""), F.lit("sample_id must be a non-empty string"), here),
        _issue("error", "invalid_source_image", F.col("ok") & (F.col("source") == ""), F.lit("source_image must be a non-empty string"), here),
        _issue("warning", "absolute_source_path", F.col("ok") & absolute, F.lit("source_image is not portable"), here),
        _issue("error", "invalid_elements", F.col("ok") & F.col("elements").isNull(), F.lit("elements must be a list"), here),
        _issue("warning", "duplicate_element_names", F.col("ok") & (F.size("repeated") > 0), F.array_join("repeated", ", "), here),
    ]
    issues = F.array_compact(F.concat(F.array(*alone), F.when(F.col("ok"), F.flatten(F.transform("e", of_element))).otherwise(F.array().cast(ISSUE))))
    keys = d.filter("ok").select("path", "sample_id", "image")
    i = images.select(F.col("path").alias("image"), "sha256", "width", F.lit(True).alias("there"))
    referenced = keys.filter("image is not null").join(i, "image", "left")
    there, read = F.coalesce("there", F.lit(False)), F.col("sha256").isNotNull()
    shared_ids = keys.filter("sample_id <> ''").groupBy("sample_id").agg(F.count("*").alias("times")).filter("times > 1")
    shared_bytes = images.groupBy("sha256").agg(F.count("*").alias("times")).filter("times > 1 and sha256 is not null")
    across = [
        _found(referenced, _issue("error", "missing_source_image", ~there, F.lit("referenced image does not exist"), F.col("image")), _issue("warning", "unknown_dimensions", there & F.col("width").isNull(), F.lit("image dimensions could not be read"), F.col("image"))),
        _found(images, _issue("error", "unreadable_image", ~read, F.lit("image could not be read"), here)),
        _found(keys.join(shared_ids, "sample_id"), _issue("error", "duplicate_sample_id", F.lit(True), F.format_string("sample_id '%s' appears %d times", "sample_id", "times"), here)),
        _found(images.join(shared_bytes, "sha256"), _issue("warning", "duplicate_image", F.lit(True), F.format_string("same bytes as %d other image(s)", F.col("times") - 1), here)),
        _found(images.join(keys.select(F.col("image").alias("path")).distinct(), "path", "left_anti"), _issue("warning", "orphan_image", F.lit(True), F.lit("image is not referenced by a sample JSON"), here)),
    ]
    return reduce(DataFrame.unionByName, across, own.select(F.inline(issues)))


def audit_summary(issues: DataFrame, documents: DataFrame, images: DataFrame) -> DataFrame:
    """One row of counts: documents, images, errors, warnings, documents without error, ranges of sizes."""
    none = F.lit(None).cast("int")
    bad = issues.filter("severity = 'error'").select("path", F.lit(True).alias("bad")).distinct()
    rows = issues.select(F.col("severity").alias("kind"), none.alias("width"), none.alias("height"))
    rows = rows.unionByName(documents.select("path").join(bad, "path", "left").select(F.when(F.col("bad"), "bad").otherwise("valid").alias("kind"), none.alias("width"), none.alias("height")))
    rows = rows.unionByName(images.select(F.lit("image").alias("kind"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")))
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return rows.agg(of("error").alias("error_count"), of("warning").alias("warning_count"), of("valid").alias("valid_samples"), of("valid", "bad").alias("json_files"), of("image").alias("image_files"), *[f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))])


def smoke_problems(assigned: DataFrame, manifest: DataFrame, per_category: int = 2, categories: int = 6) -> DataFrame:
    """(problem, detail) of a smoke set: number of rows, rows a category, ids and hashes that repeat or differ
    from the manifest's."""
    total = assigned.agg(F.count("*").alias("n")).filter(F.col("n") != per_category * categories).select(F.lit("row_count").alias("problem"), F.col("n").cast("string").alias("detail"))
    uneven = assigned.groupBy("category").count().filter(F.col("count") != per_category).select(F.lit("category_count"), F.concat_ws("=", "category", "count"))
    repeats = [assigned.groupBy(c).count().filter("count > 1").select(F.lit(f"duplicate_{c}"), F.col(c)) for c in ("sample_id", "sha256")]
    m = manifest.select("sample_id", F.col("sha256").alias("_sha"))
    both = assigned.select("sample_id", "sha256").join(m, "sample_id", "full_outer")
    differ = both.filter(F.col("sha256").isNull() | F.col("_sha").isNull() | (F.col("sha256") != F.col("_sha"))).select(F.when(F.col("sha256").isNull(), "not_assigned").when(F.col("_sha").isNull(), "not_in_manifest").otherwise("hash_differs"), F.col("sample_id"))
    return reduce(DataFrame.union, [total, uneven, *repeats, differ])


def take_per_source(files: DataFrame, source: str, order: str, offset: Column, count: int = 2) -> DataFrame:
    """``count`` files of each source after its offset."""
    place = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return files.withColumn("_n", place).filter((F.col("_n") > offset) & (F.col("_n") <= offset + count)).drop("_n")
