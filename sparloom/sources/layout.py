"""Tables of files: columns out of paths, filters, and the best of several places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False, older_than: str | None = None, skip_prefix: str = "~$", skip_suffix: str = "") -> DataFrame:
    """(path, name, stem, prefix, parent, grandparent, length, modified[, content]) of the files below a folder.
    prefix: the stem up to the first underscore. Lock files are left out. ``older_than``: a timestamp."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    raw = (read.option("modifiedBefore", older_than) if older_than else read).load(root)
    part = lambda k: F.try_element_at(F.split("path", "/"), F.lit(k))
    stem = F.regexp_replace(part(-1), r"\.[^.]*$", "")
    out = raw.select("path", part(-1).alias("name"), stem.alias("stem"), F.split(stem, "_")[0].alias("prefix"), part(-2).alias("parent"), part(-3).alias("grandparent"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    out = out.filter(~F.startswith("name", F.lit(skip_prefix)))
    return out.filter(~F.endswith("name", F.lit(skip_suffix))) if skip_suffix else out


def one_per(files: DataFrame, key: str, last: bool = False) -> DataFrame:
    """One file a key: the first by path, or the last."""
    order = F.desc("path") if last else F.asc("path")
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def best_place(files: DataFrame, key: str, patterns: tuple[str, ...]) -> DataFrame:
    """(key, path, place): for each key the path that fits the earliest of the patterns (regular expressions)."""
    place = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(k)) for k, p in enumerate(patterns)])
    fit = files.withColumn("place", place).filter("place is not null")
    return fit.groupBy(key).agg(F.min_by("path", F.struct("place", "path")).alias("path"), F.min("place").alias("place"))


def presence(samples: DataFrame, files: DataFrame, key: str, flags: dict[str, str]) -> DataFrame:
    """Samples with a boolean for each named pattern: whether a file of theirs fits it."""
    found = files.groupBy(key).agg(*[F.bool_or(F.col("path").rlike(p)).alias(name) for name, p in flags.items()])
    return samples.join(found, key, "left").fillna(False, list(flags))


def _resolved(path):
    """A path without ``.`` and ``..`` parts."""
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def sample_images(spark: SparkSession, root: str, image_root: str | None = None) -> DataFrame:
    """(sample_id, metadata_path, image_path, problem) of the JSON objects {sample_id, source_image} below a folder, one a
    file. A relative image is looked up beside its file, among the files below ``image_root`` (by default the same folder).
    problem: what is wrong with the file, with its id or with its image; else null."""
    files = list_files(spark, root, "*.json", content=True).select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text"))
    d = files.withColumn("v", F.try_parse_json("text"))
    said = lambda key: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")) == "STRING", F.nullif(F.btrim(F.try_variant_get("v", f"$.{key}", "string")), F.lit("")))
    d = d.select("path", "v", said("sample_id").alias("sample_id"), said("source_image").alias("image"))
    own = F.regexp_extract("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", 0)
    place = F.when(F.col("image").rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), F.col("image")).when(F.startswith("image", F.lit("/")), F.concat(own, "image")).otherwise(F.concat(F.regexp_replace("path", "[^/]*$", ""), "image"))
    d = d.withColumns({"image_path": _resolved(place), "times": F.count("sample_id").over(Window.partitionBy("sample_id"))})
    images = list_files(spark, image_root or root).select(F.col("path").alias("image_path"), F.lit(True).alias("there"))
    wrong = (
        F.when(F.col("v").isNull(), "invalid JSON")
        .when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "JSON root is no object")
        .when(F.col("sample_id").isNull(), "missing sample_id")
        .when(F.col("times") > 1, "duplicate sample_id")
        .when(F.col("image").isNull(), "missing source_image")
        .when(F.col("there").isNull(), "image is not there")
    )
    return d.join(images, "image_path", "left").select("sample_id", F.col("path").alias("metadata_path"), "image_path", wrong.alias("problem"))


def read_sample_images(spark: SparkSession, root: str, image_root: str | None = None) -> DataFrame:
    """(sample_id, metadata_path, image_path) of ``sample_images``; a problem is an error, as is a folder without samples."""
    found = sample_images(spark, root, image_root)
    if list_files(spark, root, "*.json").isEmpty():
        raise ValueError(f"no sample JSON files below {root}")
    told = F.concat(F.col("problem"), F.lit(": "), "metadata_path")
    return found.filter(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("problem")
