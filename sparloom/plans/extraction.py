"""From the text of a model's answer to elements, rules and a review, as one chain of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.parsing import confidence_label, element_category, lenient_json, variant_items
from sparloom.functions.text import first_filled, stripped, trimmed


def features_text(v: Column) -> Column:
    """Text of a VARIANT of any depth: scalars as they are; lists and objects (key: value) with full-width semicolons
    between items; null and empty items are left out. One fold over the levels: each replaces every list and object
    among the pieces by its separators and items, so a row takes as many steps as its own value is deep."""
    piece = lambda text, value: F.struct(text.alias("text"), value.alias("value"))
    done = F.lit(None).cast("variant")
    says = lambda e: ~F.coalesce(F.to_json(e["value"]), F.lit("null")).isin("null", '""', "[]", "{}")

    def opened(p: Column) -> Column:
        x = p["value"]
        fields = F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), lambda e: piece(F.concat(e["key"], F.lit(": ")), e["value"]))
        items = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda e: piece(F.lit(""), e))
        inner = lambda e, i: F.array(piece(F.concat(F.when(i > 0, "；").otherwise(""), e["text"]), done), piece(F.lit(""), e["value"]))
        scalar = F.array(piece(stripped(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))), done))
        return F.when(x.isNull(), F.array(p)).otherwise(F.coalesce(F.flatten(F.transform(F.filter(F.coalesce(fields, items), says), inner)), scalar))

    levels = F.sequence(F.lit(0), F.coalesce(nesting(v), F.lit(0)))
    return F.aggregate(levels, F.array(piece(F.lit(""), v)), lambda pieces, _: F.flatten(F.transform(pieces, opened)), lambda pieces: F.array_join(F.transform(pieces, lambda p: p["text"]), ""))


def nesting(v: Column) -> Column:
    """How many lists and objects of a VARIANT stand in one another at most."""
    brackets = F.regexp_replace(F.to_json(v), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}]', "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"]).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.when(brackets == "", 0).otherwise(F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step)["most"])


# What is read of an item of a list, by one cast of the list.
LOOKS = ("color", "material", "shape", "location")
ITEM = f"struct<name:string,value:string,description:string,category:string,attributes:struct<{','.join(f'{a}:string' for a in LOOKS)}>,confidence:string>"


def elements(answers: DataFrame, text: str = "answer", sample: str = "sample_id") -> DataFrame:
    """(sample, element_id, name, value, category, color, material, shape, location, confidence) out of answers:
    the first list among elements, extracted_elements and atomic_rules, else the identity features, nested to any
    depth. Ids count every item of the list, also those that are left out for want of a name and a value."""
    plain = lambda *c: trimmed(F.coalesce(*c, F.lit("")))
    told = lambda n, x, category, confidence, look: F.struct(n.alias("n"), x.alias("x"), category.alias("category"), confidence.alias("confidence"), *[look(a).alias(a) for a in LOOKS])
    of_item = lambda x: told(plain(x["name"]), plain(x["value"], x["description"]), x["category"], x["confidence"], lambda a: plain(x["attributes"][a]))
    of_feature = lambda x: told(x["key"], features_text(x["value"]), F.lit("other"), F.lit("medium"), lambda a: F.lit(""))
    listed = F.coalesce(*[F.try_variant_get("v", p, f"array<{ITEM}>") for p in ("$.elements", "$.extracted_elements", "$.atomic_rules")])
    features = F.map_entries(F.try_variant_get("v", "$.identity_features", "map<string,variant>"))
    entries = F.coalesce(F.transform(listed, of_item), F.transform(features, of_feature))
    rows = answers.select(sample, lenient_json(F.col(text)).alias("v")).select(sample, F.posexplode(entries).alias("k", "e")).select(sample, "k", "e.*").filter("n <> '' or x <> ''")
    number = (F.col("k") + 1).cast("string")
    element_id = F.concat(F.coalesce(F.col(sample).cast("string"), F.lit("null")), F.lit("_e"), F.when(F.col("k") < 999, F.lpad(number, 3, "0")).otherwise(number))
    return rows.select(sample, element_id.alias("element_id"), first_filled(F.col("n"), F.substring("x", 1, 20)).alias("name"), first_filled(F.col("x"), F.col("n")).alias("value"), element_category(F.col("category")).alias("category"), *LOOKS, confidence_label(F.col("confidence")).alias("confidence"))


def as_rules(found: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Elements as rules; those without an id or a value are left out."""
    return found.select(sample, trimmed("element_id").alias("rule_id"), trimmed("value").alias("value")).filter("rule_id <> '' and value <> ''")


def answer_items(text: Column, *paths: str) -> Column:
    return variant_items(lenient_json(text), *paths)
