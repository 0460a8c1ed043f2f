"""Colour families of a text and sets of colours that count as one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.text import constant, let

_BY_LENGTH = sorted(((w.lower(), f) for f, ws in V.COLOR_ALIASES.items() for w in ws), key=lambda x: -len(x[0]))
_WORDS = [{"word": w, "family": f} for w, f in _BY_LENGTH]


def color_families(text: Column | str) -> Column:
    """Sorted families of a text. Longest words claim their characters first; a word claims its first free place
    only. What is claimed is blanked out, so that nothing shorter is found there. One fold over the words that the
    text holds, in the JVM."""

    def claim(s: Column, x: Column) -> Column:
        at = F.call_function("instr", s["low"], x["word"])
        claimed = F.struct(F.overlay(s["low"], F.repeat(F.lit("\0"), F.length(x["word"])), at).alias("low"), F.concat(s["found"], F.array(x["family"])).alias("found"))
        return F.when(F.contains(s["low"], x["word"]), claimed).otherwise(s)

    def fold(low: Column) -> Column:
        held = F.filter(constant(_WORDS), lambda x: F.contains(low, x["word"]))
        return F.aggregate(held, F.struct(low.alias("low"), F.array().cast("array<string>").alias("found")), claim, lambda s: s["found"])

    whole = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.array_sort(F.array_distinct(let(whole, fold)))


def within_one_group(families: Column) -> Column:
    """Two families or more, all inside one tolerated group."""
    inside = F.exists(constant(V.TOLERATED_COLORS), lambda group: F.size(F.array_except(families, group)) == 0)
    return (F.size(families) >= 2) & inside


def tolerated(families: Column) -> Column:
    """within_one_group, except red with brown but no red-brown, and black with brown but no dark shade
    between them."""
    has = lambda c: F.array_contains(families, c)
    red_and_brown = has("red") & has("brown") & ~has("red_brown")
    black_and_brown = has("black") & has("brown") & ~(has("dark_gray") | has("gray_brown") | has("dark_brown"))
    return within_one_group(families) & ~red_and_brown & ~black_and_brown
