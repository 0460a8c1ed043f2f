"""Tag bags, subjects and signatures of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.text import characters, stripped


def tag_set(tags: Column) -> Column:
    """Distinct tags of a text with blanks between them."""
    return F.array_distinct(F.filter(F.split(F.coalesce(tags, F.lit("")), characters(V.WHITE) + "+"), lambda t: t != ""))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_any(tags: Column, values) -> Column:
    return F.arrays_overlap(tags, literals(values))


def hits(tags: Column, values) -> Column:
    """The tags that are among ``values``, sorted."""
    return F.array_sort(F.array_intersect(tags, literals(values)))


def single_subject(tags: Column) -> Column:
    """A subject tag, no count of several and no group tag."""
    several = F.exists(tags, lambda t: t.rlike(r"^\d+(girls|boys|people|persons)$"))
    return has_any(tags, V.SUBJECT_TAGS) & ~several & ~has_any(tags, V.GROUP_TAGS)


def source_key(source: Column) -> Column:
    """The first URL of a text, or the text: without slashes at the end, lower-cased, then without query and
    fragment."""
    text = stripped(F.coalesce(source, F.lit("")))
    url = F.regexp_extract(text, r"https?://\S+", 0)
    return F.regexp_replace(F.lower(F.rtrim(F.when(url != "", url).otherwise(text), F.lit("/"))), r"[?#].*$", "")


def character_signature(tags: Column, source: Column, post_id: Column) -> Column:
    """What tells a character: its first five specific tags, else its source, else the post."""
    ignored = literals(dict.fromkeys((*V.GENERIC_TAGS, *V.COMMON_TRAITS, *V.NEGATIVE_TAGS, *V.NON_HUMAN_TAGS, *V.PARTIAL_VIEW_TAGS)))
    suffix = "(" + "|".join(V.VISUAL_SUFFIXES) + ")$"
    own = F.filter(F.array_except(tags, ignored), lambda t: ~F.startswith(t, F.lit("rating:")) & ~t.rlike(suffix) & ~t.rlike(r"^\d+(girl|boy|girls|boys|people|persons)$"))
    first = F.array_join(F.slice(F.array_sort(own), 1, 5), "|")
    key = source_key(source)
    return F.when(first != "", F.concat(F.lit("character_tags:"), first)).when(key != "", F.concat(F.lit("source:"), key)).otherwise(F.concat(F.lit("post:"), post_id.cast("string")))


def identity_signature(rules: Column) -> Column:
    """Sorted id=value pairs of the identity rules (array of struct with id and value), joined by bars."""
    starts = lambda rid: F.greatest(*[F.startswith(rid, F.lit(p)) for p in V.IDENTITY_PREFIXES])
    pairs = F.transform(F.filter(rules, lambda r: starts(r["id"]) & (stripped(r["value"]) != "")), lambda r: F.concat_ws("=", r["id"], stripped(r["value"])))
    return F.array_join(F.array_sort(pairs), "|")
