"""Corrections of rules in place: the rules asked about, and updates that must still fit what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions.text import snake_case, stripped


def position_rules(rules: DataFrame, only_sides: bool = False, document: str = "path", place: str = "position") -> DataFrame:
    """Rules whose id ends in _position (with ``only_sides``: whose value names left or right), numbered from 0
    within their document as position_index."""
    kept = rules.filter(F.endswith(F.lower("rule_id"), F.lit("_position")))
    kept = kept.filter(F.col("value").rlike("(?i)left|right")) if only_sides else kept
    return kept.withColumn("position_index", F.row_number().over(Window.partitionBy(document).orderBy(place)) - 1)


def apply_updates(rules: DataFrame, asked: DataFrame, updates: DataFrame, document: str = "path", place: str = "position") -> DataFrame:
    """``rules`` with new_value and changed. An update (document, ordinal, position_index, id, old_value,
    corrected_value) belongs to the asked rule of its position_index, else to that of its ordinal; it counts
    if its id and old value, where given, are still the rule's, and the corrected value is new and filled."""
    u = updates.select(document, "ordinal", F.col("position_index").try_cast("int").alias("position_index"), "id", "old_value", stripped("corrected_value").alias("corrected_value"))
    one = F.struct("id", "old_value", "corrected_value")
    by_place = u.filter("position_index is not null").groupBy(document, "position_index").agg(F.max_by(one, "ordinal").alias("_a"))
    by_ordinal = u.select(document, F.col("ordinal").alias("position_index"), one.alias("_b"))
    chosen = asked.select(document, place, "position_index").join(by_place, [document, "position_index"], "left").join(by_ordinal, [document, "position_index"], "left").select(document, place, F.coalesce("_a", "_b").alias("_u"))
    d = rules.join(chosen, [document, place], "left")
    fits = (F.coalesce("_u.id", "rule_id") == F.col("rule_id")) & (F.coalesce("_u.old_value", "value") == F.col("value"))
    changed = F.coalesce(fits & (F.col("_u.corrected_value") != "") & (F.col("_u.corrected_value") != F.col("value")), F.lit(False))
    return d.withColumns({"changed": changed, "new_value": F.when(changed, F.col("_u.corrected_value")).otherwise(F.col("value"))}).drop("_u")


def checked_rules(rules: DataFrame, document: str = "path", place: str = "position") -> DataFrame:
    """Rules with a snake_case id, the first of each id within its document, in place order. A location other
    than head or body is an error."""
    where = F.lower(stripped(F.coalesce("location", F.lit(""))))
    d = rules.withColumn("rule_id", snake_case(F.col("rule_id"))).filter("value is not null")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(document, "rule_id").orderBy(place))).filter("_n = 1").drop("_n")
    return d.withColumn("location", F.when(where.isin("head", "body"), where).otherwise(F.raise_error(F.concat(F.lit("rule needs location=head or location=body: "), F.col("rule_id")))))
