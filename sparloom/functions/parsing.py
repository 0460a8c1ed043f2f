"""Lenient parsing: confidences, numbers, JSON out of model text, ids and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.text import clean, stripped, trimmed


def as_float(c: Column) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(stripped(c.cast("string")).try_cast("double"), F.lit(0.0))


def event_confidence(c: Column, is_number: bool = False) -> Column:
    """Confidence of an event: numbers as they are; words high, very_high, medium, low; any other text is 1."""
    if is_number:
        return F.coalesce(c.cast("double"), F.lit(1.0))
    text = F.lower(c.cast("string"))
    return F.when(text.isin("high", "very_high"), 0.95).when(text == "medium", 0.75).when(text == "low", 0.5).otherwise(1.0)


def confidence_words(c: Column) -> Column:
    """A confidence as lower-cased words."""
    return F.replace(F.lower(trimmed(F.coalesce(c.cast("string"), F.lit("")))), F.lit("_"), F.lit(" "))


def confidence_of_words(words: Column) -> Column:
    """Confidence, between 0 and 1, of ``confidence_words``: some words, numbers; anything else is 0.75."""
    word = F.coalesce(*[F.when(words == w, F.lit(v)) for w, v in V.CONFIDENCE_WORDS.items()])
    number = words.try_cast("double")
    return F.coalesce(word, F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.lit(0.75))


def review_confidence(c: Column) -> Column:
    """Confidence of a review, between 0 and 1: words, numbers also as text; anything else is 0.75."""
    return confidence_of_words(confidence_words(c))


def confidence_label(c: Column) -> Column:
    """high, medium or low; some numbers and very high are high; anything else is medium."""
    text = confidence_words(c)
    return F.when(text.isin("high", "medium", "low"), text).when(text.isin("very high", "0.9", "0.95", "1.0"), "high").otherwise("medium")


def element_category(c: Column) -> Column:
    text = F.translate(F.lower(trimmed(F.coalesce(c.cast("string"), F.lit("")))), "- ", "__")
    return F.when(text.isin(*V.ELEMENT_CATEGORIES), text).otherwise("other")


def repaired_status(c: Column) -> Column:
    """A status with its underscores and shortened forms repaired."""
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in V.STATUS_REPAIRS.items()], c)


def recomputed_result(*statuses: Column) -> Column:
    """wrong if any view's status is an error, else correct; an earlier ``unsure`` is lost."""
    wrong = F.lit(False)
    for s in statuses:
        wrong = wrong | F.coalesce(s.isin(*V.REVIEW_ERROR_STATUSES), F.lit(False))
    return F.when(wrong, "wrong").otherwise("correct")


def inferred_attribute(rule_id: Column, issue_type: Column) -> Column:
    """Attribute named by the issue, else by parts of the rule's id."""
    has = lambda *parts: F.greatest(*[F.contains(rule_id, F.lit(p)) for p in parts]) if len(parts) > 1 else F.contains(rule_id, F.lit(parts[0]))
    chain = F.when(issue_type == "wrong color", "color").when(issue_type == "wrong material", "material").when(issue_type == "wrong shape", "shape")
    return chain.when(has("color"), "color").when(has("material", "fabric"), "material").when(has("type", "style", "shape"), "shape").otherwise("other")


def rule_location(rule_id: Column) -> Column:
    """head or body by the rule's id; null if the id does not tell."""
    rid = F.lower(rule_id)
    starts = lambda prefixes: F.greatest(*[F.startswith(rid, F.lit(p)) for p in prefixes])
    head = rid.isin(*V.HEAD_IDS) | starts(V.HEAD_PREFIXES) | F.greatest(*[F.contains(rid, F.lit(p)) for p in V.HEAD_PARTS])
    return F.when(head, "head").when(starts(V.BODY_PREFIXES) | rid.isin(*V.BODY_IDS), "body")


def rejection_kind(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(F.greatest(*[F.contains(low, F.lit(m)) for m in V.REJECTION_MARKERS]), "content_policy_or_provider_rejection").otherwise("runtime_error")


def lenient_json(text: Column) -> Column:
    """VARIANT of model text: code fences stripped; else what stands between the first { and the last };
    null if neither parses."""
    text = stripped(F.coalesce(text, F.lit("")))
    bare = F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, r"(?s)^```[A-Za-z]*\s*|\s*```\s*$", "")).otherwise(text)
    whole = F.when(F.substring(bare, 1, 1).isin(*'{["-0123456789tfn'), F.try_parse_json(bare))  # what begins otherwise is no JSON
    return F.coalesce(whole, F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def variant_text(v: Column, path: str) -> Column:
    """Text of a scalar inside a VARIANT; objects and arrays as JSON."""
    return F.try_variant_get(v, path, "string")


def variant_items(v: Column, *paths: str) -> Column:
    """The first of ``paths`` that is an array, as array of VARIANT; else empty."""
    return F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths], F.array().cast("array<variant>"))


def parameter(raw: Column) -> Column:
    """Struct (key, value as JSON text) of KEY=VALUE; a value that is no JSON is a JSON string."""
    parts = F.split(raw, "=", 2)
    value = F.get(parts, F.lit(1))
    typed = F.when(F.try_parse_json(value).isNotNull(), value).otherwise(F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6))
    return F.struct(F.get(parts, F.lit(0)).alias("key"), typed.alias("value"))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root`` with forward slashes; paths elsewhere as they are."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(prefix)), F.substring(slashed, len(prefix) + 1, 1 << 20)).otherwise(slashed)


def bounded(c: Column, name: str) -> Column:
    """A number from 0 to 1, else an error that names it."""
    return F.when(c.between(0.0, 1.0), c).otherwise(F.raise_error(F.lit(f"{name} must be a number from 0 to 1")).cast("double"))


def column_number(cell: Column) -> Column:
    """Zero-based column of a cell reference such as AB12."""
    letters = F.regexp_replace(F.upper(cell), "[^A-Z]", "")
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def position_value(c: Column) -> Column:
    """Left and right stay as they are written: a viewer's side is not turned into the figure's."""
    return c


def rounded(x: Column, digits: int) -> Column:
    """A number from 1/128 up to 8 to ``digits`` places, by its exact binary value and ties to even, as Python rounds;
    Spark's own functions round the decimal text of a number. Smaller ones are cut to 60 binary places first."""
    scale, one = 10**digits, 1 << 60
    exact = (x * F.lit(float(one))).cast("bigint").cast("decimal(20,0)") * F.lit(scale).cast("decimal(8,0)")
    down = F.call_function("div", exact, F.lit(one).cast("decimal(20,0)"))
    rest = (exact - down.cast("decimal(20,0)") * F.lit(one).cast("decimal(20,0)")) * F.lit(2).cast("decimal(2,0)")
    up = (rest > one) | ((rest == one) & (down % 2 == 1))
    return (down + up.cast("bigint")) / F.lit(float(scale))
