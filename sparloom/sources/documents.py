"""JSON documents of changing shape: rules, elements, sample configurations, prediction summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparloom.functions.parsing import variant_items, variant_text
from sparloom.functions.text import first_filled, stripped
from sparloom.sources.tables import exists

EMPTY = "path string, v variant"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, v): whole files as VARIANT, null where a file is no JSON. No files: no rows."""
    if not exists(spark, path):
        return spark.sql("select '' as path, parse_json('null') as v").limit(0)
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))


def sample_of(path: str = "path"):
    """The name of the folder that holds the file."""
    return F.element_at(F.split(F.col(path), "/"), -2)


def rules(documents: DataFrame) -> DataFrame:
    """(path, position, rule_id, location, value) of rule documents: {"atomic_rules": [...]} or a list; the
    id is the first filled of rule_id, id and name; a rule needs an id; other items are left out."""
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), variant_items(F.col("v"), "$.atomic_rules"))
    one = documents.select("path", F.posexplode(items).alias("position", "r"))
    get = lambda k: variant_text(F.col("r"), f"$.{k}")
    out = one.select("path", "position", stripped(first_filled(get("rule_id"), get("id"), get("name"))).alias("rule_id"), F.lower(F.coalesce(get("location"), F.lit(""))).alias("location"), stripped(F.coalesce(get("value"), F.lit(""))).alias("value"))
    return out.filter("rule_id <> ''")


def elements(documents: DataFrame, dedupe: bool = False) -> DataFrame:
    """(path, position, element_id, name, value, category, color, material, shape, location, confidence) of
    element documents; a value under the key "value:" counts; ``dedupe``: first of each name and value."""
    one = documents.select("path", F.posexplode(variant_items(F.col("v"), "$.elements")).alias("position", "e"))
    get = lambda k: F.coalesce(variant_text(F.col("e"), k), F.lit(""))
    value = first_filled(variant_text(F.col("e"), "$.value"), variant_text(F.col("e"), "$['value:']"))
    out = one.select("path", "position", get("$.element_id").alias("element_id"), get("$.name").alias("name"), value.alias("value"), get("$.category").alias("category"), *[get(f"$.attributes.{a}").alias(a) for a in ("color", "material", "shape", "location")], get("$.confidence").alias("confidence"))
    if dedupe:
        first = Window.partitionBy("path", "name", "value").orderBy("position")
        out = out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return out


def registry(configs: DataFrame, wrapped_only: bool = False) -> DataFrame:
    """(sample_id, category, source_image, multiview_image, atomic_rules, path, position) of configurations:
    {"samples": [...]} or, unless ``wrapped_only``, a list."""
    wrapped = variant_items(F.col("v"), "$.samples")
    items = wrapped if wrapped_only else F.coalesce(F.try_variant_get("v", "$", "array<variant>"), wrapped)
    one = configs.select("path", F.posexplode(items).alias("position", "s"))
    fields = ("sample_id", "category", "source_image", "multiview_image", "atomic_rules")
    return one.select(*[F.coalesce(variant_text(F.col("s"), f"$.{k}"), F.lit("")).alias(k) for k in fields], "path", "position").filter("sample_id <> ''")


def registered_rules(samples: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Rules of each registered sample, joined by the end of the rule file's path: its last two parts, and of files
    that agree in these, those whose path ends with the whole registered one, where there are any."""
    name = lambda c: F.substring_index(c, "/", -2)
    found = samples.drop("path", "position").join(rule_rows.withColumn("_k", name(F.col("path"))), name(F.col("atomic_rules")) == F.col("_k")).drop("_k")
    end = F.regexp_replace("atomic_rules", r"^(?:\.?/)+", "")
    whole = (F.col("path") == end) | F.endswith("path", F.concat(F.lit("/"), end))
    best = F.max("_whole").over(Window.partitionBy("category", "sample_id", "atomic_rules"))
    return found.withColumn("_whole", whole).withColumn("_best", best).filter("_whole = _best").drop("_whole", "_best")


def prediction_runs(documents: DataFrame) -> DataFrame:
    """(category, sample_id, rules, qc_pass, qc_warn, qc_fail, path) of run summaries <category>/<sample>/summary.json;
    what a summary lacks comes from its path; files that are no JSON are left out."""
    part = lambda k: F.element_at(F.split("path", "/"), k)
    number = lambda p: F.coalesce(F.try_variant_get("v", p, "bigint"), F.lit(0))
    return documents.filter("v is not null").select(first_filled(variant_text(F.col("v"), "$.category"), part(-3)).alias("category"), first_filled(variant_text(F.col("v"), "$.sample_id"), part(-2)).alias("sample_id"), number("$.rule_count").alias("rules"), *[number(f"$.qc_counts.{s}").alias(f"qc_{s.lower()}") for s in ("PASS", "WARN", "FAIL")], "path")


def settings(documents: DataFrame) -> DataFrame:
    """(path, section, key, value) of configuration documents that nothing interprets, such as severity policies:
    entries of the root, and of the objects in it; values as text, lists and deeper objects as JSON."""
    entries = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    top = documents.select("path", F.explode(entries(F.col("v"))).alias("e")).select("path", F.col("e.key").alias("section"), F.col("e.value").alias("v"))
    inner = F.coalesce(entries(F.col("v")), F.array(F.struct(F.lit("").alias("key"), F.col("v").alias("value"))))
    return top.select("path", "section", F.explode(inner).alias("e")).select("path", "section", F.col("e.key").alias("key"), F.coalesce(F.try_variant_get("e.value", "$", "string"), F.to_json("e.value")).alias("value"))
