"""Text columns: blanks, tokens, set similarities, names and families of keywords."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom import vocabulary as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def stripped(c: Column | str) -> Column:
    """Text without white space of any script at its ends."""
    return F.btrim(c, F.lit(V.WHITE))


def trimmed(c: Column | str) -> Column:
    """``stripped`` of a plain column: ends are looked at first, as trimming by a set of characters is slow."""
    c = F.col(c) if isinstance(c, str) else c
    blank_end = F.substring(c, 1, 1).isin(*V.WHITE) | F.substring(c, -1, 1).isin(*V.WHITE)
    return F.when(blank_end, stripped(c)).otherwise(c)


def characters(chars: str) -> str:
    """A character class of a regular expression that holds just these."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def clean(c: Column) -> Column:
    """Trimmed text, null as blank."""
    return F.coalesce(stripped(c.cast("string")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank, else blank."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(""))


def joined_filled(*columns: Column) -> Column:
    """The filled columns, separated by blanks."""
    return F.concat_ws(" ", *[F.nullif(c.cast("string"), F.lit("")) for c in columns])


FINDING_TEXT = ("human_rule_name", "element_name", "feature_key", "attribute", "expected_value", "expected_from_2d", "observed_value", "observed_in_multiview", "issue_type")


def finding_text(columns: Iterable[str]) -> Column:
    """The text of a finding: its descriptive columns, as far as ``columns`` has them."""
    have = set(columns)
    return joined_filled(*[F.col(c) for c in FINDING_TEXT if c in have])


def tokens(text: Column) -> Column:
    """Distinct tokens: lower-cased runs of ASCII letters and digits, without stop words, aliases replaced.
    Text in other scripts has none."""
    alias = F.create_map(*[F.lit(x) for pair in V.ALIASES.items() for x in pair])
    kept = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9]+"), lambda t: (t != "") & ~t.isin(*V.STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.try_element_at(alias, t), t)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def compact_text(text: Column, strip_ascii: bool = True) -> Column:
    """Text without white space and punctuation; in the element form also without ASCII letters, lower-cased."""
    text = F.coalesce(text, F.lit(""))
    text = F.lower(F.regexp_replace(text, "[A-Za-z]+", "")) if strip_ascii else text
    return F.regexp_replace(text, characters(V.WHITE + V.PUNCTUATION) + "+", "")


def char_set(text: Column, strip_ascii: bool = True) -> Column:
    return F.array_distinct(F.filter(F.split(compact_text(text, strip_ascii), ""), lambda c: c != ""))


def set_overlap(a: Column, b: Column) -> Column:
    """The larger of Jaccard and overlap with the smaller set; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    best = F.greatest(shared / F.size(F.array_union(a, b)), shared / F.least(F.size(a), F.size(b)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), best).otherwise(F.lit(0.0))


def char_similarity(a: Column, b: Column, strip_ascii: bool = True) -> Column:
    return let(char_set(a, strip_ascii), lambda x: let(char_set(b, strip_ascii), lambda y: set_overlap(x, y)))


def append_once(current: Column, item: Column) -> Column:
    """``item`` added to a semicolon list unless it is there."""
    current = F.coalesce(current, F.lit(""))
    return F.when(current == "", item).when(F.array_contains(F.split(current, ";"), item), current).otherwise(F.concat_ws(";", current, item))


def with_safe_rating(tags: Column) -> Column:
    """A tag query with single blanks that asks for safe ratings."""
    tags = F.array_join(F.filter(F.split(F.coalesce(tags, F.lit("")), characters(V.WHITE) + "+"), lambda t: t != ""), " ")
    return F.when(F.array_contains(F.split(tags, " "), "rating:safe"), tags).otherwise(F.btrim(F.concat_ws(" ", tags, F.lit("rating:safe"))))


def slug(text: Column, fallback: str = "item") -> Column:
    """Lower-case file name: runs of other characters are one underscore."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9._-]+", "_"), F.lit("_.")), F.lit("")), F.lit(fallback))


def snake_case(text: Column) -> Column:
    made = F.lower(F.btrim(F.regexp_replace(stripped(F.coalesce(text.cast("string"), F.lit(""))), "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("unnamed_rule"))


def composite_parts(name: Column) -> Column:
    """Parts of a name at the joining character, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), "与"), stripped), lambda p: p != "")


def compound_halves(name: Column) -> Column:
    """[left, right] at the first joining character, in their order of preference, if both halves have two
    characters or more; else an empty array. Whether they differ enough is for the caller's vectors."""
    none = F.array().cast("array<string>")
    chosen = none
    for joint in ("和", "及", "与"):
        halves = F.transform(F.split(F.coalesce(name, F.lit("")), joint, 2), stripped)
        chosen = F.when((F.size(halves) == 2) & F.forall(halves, lambda p: F.length(p) >= 2), halves).otherwise(chosen)
    return chosen


def constant(rows: list) -> Column:
    """A constant array of texts, or of lists or dicts (as structs) of constants, made in one call: plans of many words
    are slow to put together column by column."""

    def sql(x) -> str:
        if isinstance(x, dict):
            return "named_struct(" + ", ".join(f"{sql(k)}, {sql(v)}" for k, v in x.items()) + ")"
        if isinstance(x, (list, tuple)):
            return "array(" + ", ".join(map(sql, x)) + ")"
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr(sql(rows))


def families(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Sorted names of the families with a keyword in the compacted text."""
    table = [{"family": f, "words": ks} for f, ks in sorted(words.items()) if ks]
    if not table:
        return F.array().cast("array<string>")
    found = lambda t: F.transform(F.filter(constant(table), lambda x: F.exists(x["words"], lambda w: F.contains(t, w))), lambda x: x["family"])
    return let(compact_text(text), found)
