"""Coverage audit of gold elements by predicted elements: families of keywords, similarity, conflicts.

Pairs are an equality join on the sample; the best pair of each gold object is a max_by over structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.colors import color_families, within_one_group
from sparloom.functions.text import char_set, composite_parts, families, set_overlap
from sparloom.operators.shared import materialize

THRESHOLD, SUPPORTED = 0.32, 0.75


def prepared(df: DataFrame, side: str) -> DataFrame:
    """(sample_id, <side>_*) of elements (sample_id, index, name, value, category, color, material, shape,
    location): texts, character sets and families, made once a row."""
    full = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "value", "category", "color", "material", "shape", "location")])
    d = df.select("sample_id", F.col("index"), F.coalesce("name", F.lit("")).alias("name"), full.alias("text"))
    plain = F.regexp_replace("text", V.ACCESSORY_MATERIAL, "")
    d = d.withColumns({"chars": char_set(F.col("text")), "name_chars": char_set(F.col("name")), "named": families(F.col("name"), V.OBJECT_FAMILIES), "full": families(F.col("text"), V.OBJECT_FAMILIES), "colors": families(plain, V.COLOR_FAMILIES), "materials": families(plain, V.MATERIAL_FAMILIES), "shapes": families(plain, V.SHAPE_FAMILIES), "shades": color_families("text")})
    detail = F.array_intersect("full", F.array(*map(F.lit, V.DETAIL_OBJECTS)))
    primary = F.array_union("named", detail) if side == "pred" else F.col("named")
    d = d.withColumns({"primary": primary}).withColumns({"secondary": F.array_except("full", "primary"), "all": F.when(F.size("primary") > 0, F.col("primary")).otherwise(F.col("full"))})
    return d.select("sample_id", *[F.col(c).alias(f"{side}_{c}") for c in d.columns if c != "sample_id"])


FIELDS = ("name", "value", "category", "color", "material", "shape", "location")
#: A similarity of two texts that a caller may put into the score of a pair.
Scorer = Callable[[Column, Column], Column]


def said(df: DataFrame, side: str) -> DataFrame:
    """(sample_id, <side>_index, <side>_name, <side>_said) of elements: what they say, as one struct. What is in this
    form already stays as it is."""
    if f"{side}_said" in df.columns:
        return df
    words = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIELDS])
    return df.select("sample_id", F.col("index").alias(f"{side}_index"), F.coalesce("name", F.lit("")).alias(f"{side}_name"), words.alias(f"{side}_said"))


def looks(df: DataFrame, side: str) -> DataFrame:
    """``prepared`` of what elements in the form of ``said`` say, once each, as a table."""
    once = df.select(F.col(f"{side}_said").alias("index")).distinct().select(F.lit("").alias("sample_id"), "index", "index.*")
    return materialize(prepared(once, side).drop("sample_id").withColumnRenamed(f"{side}_index", f"{side}_said"), "coverage-looks")


def met(gold: DataFrame, pred: DataFrame, how: str, scorer: Scorer | None) -> tuple[DataFrame, DataFrame]:
    """(pairs, gold looks): gold and predicted elements of a sample (``said``; left or right: also those without any) with
    ``score``, shared objects ``first`` and ``second``, whether any are ``shared``, and conflicts ``c``. Each pair of what
    is said is looked at once, however many elements say it."""
    pairs, g, p = gold.join(pred, "sample_id", how), looks(gold, "gold"), looks(pred, "pred")
    texts = gold.join(pred, "sample_id").select("gold_said", "pred_said").distinct()
    both = texts.join(g, "gold_said").join(p, "pred_said")
    told = both.select("gold_said", "pred_said", relation(scorer).alias("score"), F.array_intersect("gold_named", "pred_primary").alias("first"), F.array_intersect("gold_named", "pred_secondary").alias("second"), F.arrays_overlap("gold_all", "pred_primary").alias("shared"), conflicts().alias("c"))
    return pairs.join(materialize(told, "coverage-pairs"), ["gold_said", "pred_said"], "inner" if how == "inner" else "left"), g


def relation(scorer: Scorer | None = None, gold: str = "gold", pred: str = "pred") -> Column:
    """Score of a pair: characters of the texts; of the names if they share two or more; shared objects, in
    the prediction's name or else in its text; and what a ``scorer`` gives for the two texts."""
    g, p = (lambda c: F.col(f"{gold}_{c}")), (lambda c: F.col(f"{pred}_{c}"))
    names = F.when(F.size(F.array_intersect(g("name_chars"), p("name_chars"))) >= 2, set_overlap(g("name_chars"), p("name_chars"))).otherwise(0.0)
    first, second = F.size(F.array_intersect(g("all"), p("primary"))), F.size(F.array_intersect(g("all"), p("secondary")))
    objects = F.when(first > 0, F.least(F.lit(0.9), 0.62 + 0.08 * first)).when(second > 0, F.least(F.lit(0.72), 0.5 + 0.06 * second)).otherwise(0.0)
    own = F.greatest(set_overlap(g("chars"), p("chars")), names, objects)
    if scorer is None:
        return own
    given = scorer(g("text"), p("text"))
    return F.greatest(own, F.when(F.isnan(given), F.lit(0.0)).otherwise(F.coalesce(given, F.lit(0.0))))


def _apart(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _note(kind: str, a: Column, b: Column) -> Column:
    shown = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))
    return F.concat(F.lit(f"{kind} conflict: gold="), shown(a), F.lit(", pred="), shown(b))


def conflicts(gold: str = "gold", pred: str = "pred") -> Column:
    """Struct (notes, tolerated): colours and materials without a common family, opposite shapes; colours that
    differ inside one tolerated group are tolerated instead, with the shades that show it."""
    g, p = (lambda c: F.col(f"{gold}_{c}")), (lambda c: F.col(f"{pred}_{c}"))
    opposite = F.lit(False)
    for a, b in V.SHAPE_OPPOSITES:
        for x, y in ((a, b), (b, a)):
            opposite = opposite | (F.array_contains(g("shapes"), x) & F.array_contains(p("shapes"), y))
    both = F.array_sort(F.array_union(g("shades"), p("shades")))
    singles = F.flatten(F.transform(F.filter(g("shades"), lambda s: within_one_group(F.array_union(p("shades"), F.array(s)))), lambda s: F.array_union(p("shades"), F.array(s))))
    ok = within_one_group(both) | (F.size(singles) > 0)
    differ = _apart(g("colors"), p("colors"))
    notes = F.array_compact(F.array(F.when(differ & ~ok, _note("color", g("colors"), p("colors"))), F.when(_apart(g("materials"), p("materials")), _note("material", g("materials"), p("materials"))), F.when(opposite, _note("shape", g("shapes"), p("shapes")))))
    shades = F.when(F.size(singles) > 0, F.array_sort(F.array_distinct(singles))).otherwise(both)
    return F.struct(notes.alias("notes"), F.when(differ & ok, shades).alias("tolerated"))


def audit_simple(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD, scorer: Scorer | None = None) -> DataFrame:
    """(sample_id, gold_index, gold_name, covered, covering, best_score, missing, conflict_notes, tolerated) of gold
    elements with one name: all objects of the name must be found in some prediction, the best of each is
    chosen; a name without objects, or with none found, is covered by score alone."""
    g = said(gold, "gold")
    pairs, look = met(g, said(pred, "pred"), "inner", scorer)
    pairs = pairs.filter((F.col("score") >= threshold) | (F.size("first") + F.size("second") > 0))
    item = F.struct(F.col("pred_index").alias("i"), F.col("score").alias("s"), F.col("c.notes").alias("n"), F.col("c.tolerated").alias("t"))
    rank = F.struct((F.size("first") > 0).alias("a"), F.size("first").alias("b"), F.size("second").alias("c"), F.col("score").alias("d"), (-F.col("pred_index")).alias("e"))
    best = pairs.groupBy("sample_id", "gold_index").agg(F.max_by(item, rank).alias("top"))
    of_object = pairs.select("sample_id", "gold_index", item.alias("item"), F.explode(F.array_union("first", "second")).alias("object"), "first")
    chosen = of_object.groupBy("sample_id", "gold_index", "object").agg(F.max_by("item", F.struct(F.array_contains("first", F.col("object")), "item.s", -F.col("item.i"))).alias("item"))
    found = chosen.groupBy("sample_id", "gold_index").agg(F.collect_set("object").alias("objects"), F.collect_set("item").alias("items"))
    d = g.join(look.select("gold_said", F.col("gold_named").alias("required")), "gold_said").select("sample_id", "gold_index", "gold_name", "required").join(best, ["sample_id", "gold_index"], "left").join(found, ["sample_id", "gold_index"], "left")
    by_score = F.col("items").isNull() & (F.col("top.s") >= threshold)
    items = F.when(by_score, F.array("top")).otherwise(F.coalesce("items", F.array().cast(d.schema["items"].dataType)))
    d = d.withColumns({"items": items, "best_score": F.round(F.coalesce("top.s", F.lit(0.0)), 3), "missing": F.when(by_score, F.array().cast("array<string>")).otherwise(F.array_except("required", F.coalesce("objects", F.array().cast("array<string>"))))})
    covered = F.when(by_score, True).when(F.size("required") > 0, F.size("missing") == 0).otherwise(F.coalesce(F.col("top.s") >= threshold, F.lit(False)))
    ordered = F.array_sort(F.transform("items", lambda x: F.struct((-x["s"]).alias("o"), x["i"].alias("i"), x["n"].alias("n"), x["t"].alias("t"))))
    return d.select("sample_id", "gold_index", "gold_name", covered.alias("covered"), F.transform(ordered, lambda x: x["i"]).alias("covering"), "best_score", F.array_sort("missing").alias("missing"), F.flatten(F.transform(ordered, lambda x: x["n"])).alias("conflict_notes"), F.array_compact(F.transform(ordered, lambda x: x["t"])).alias("tolerated"))


def audit_composite(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD, scorer: Scorer | None = None) -> DataFrame:
    """The same for gold names of several parts: every part must reach the threshold with some prediction; one
    prediction may serve several parts, and is held against the first of them for conflicts."""
    parts = gold.select("sample_id", F.col("index").alias("of"), F.col("name").alias("whole"), F.posexplode(composite_parts(F.col("name"))).alias("part", "name"))
    as_elements = parts.select("sample_id", F.struct("of", "part").alias("index"), "name", *[F.lit("").alias(c) for c in ("value", "category", "color", "material", "shape", "location")])
    pairs, look = met(said(as_elements, "gold"), said(pred, "pred"), "left", scorer)
    pairs = pairs.withColumn("score", F.coalesce("score", F.lit(0.0)))
    item = F.struct(F.col("pred_index").alias("i"), F.col("score").alias("s"), F.col("c.notes").alias("n"), F.col("c.tolerated").alias("t"))
    best = pairs.groupBy("sample_id", "gold_index", "gold_said").agg(F.max_by(item, F.struct("score", -F.col("pred_index"))).alias("b")).join(look.select("gold_said", "gold_named"), "gold_said")
    one = F.struct(F.col("gold_index.part").alias("part"), ((F.col("b.s") >= threshold) & (F.col("b.s") > 0)).alias("ok"), F.col("b").alias("b"), F.col("gold_named").alias("named"))
    by_gold = best.groupBy("sample_id", F.col("gold_index.of").alias("gold_index")).agg(F.array_sort(F.collect_list(one)).alias("parts"))
    d = by_gold.join(gold.select("sample_id", F.col("index").alias("gold_index"), F.col("name").alias("gold_name")), ["sample_id", "gold_index"])
    ok = F.filter("parts", lambda x: x["ok"])
    fresh = F.filter(ok, lambda x, k: F.array_position(F.transform(ok, lambda y: y["b"]["i"]), x["b"]["i"]) == k + 1)
    required = families(F.col("gold_name"), V.OBJECT_FAMILIES)
    return d.select("sample_id", "gold_index", "gold_name", F.forall("parts", lambda x: x["ok"]).alias("covered"), F.transform(fresh, lambda x: x["b"]["i"]).alias("covering"), F.round(F.array_max(F.transform("parts", lambda x: F.coalesce(x["b"]["s"], F.lit(0.0)))), 3).alias("best_score"), F.array_sort(F.array_except(required, F.flatten(F.transform(ok, lambda x: x["named"])))).alias("missing"), F.flatten(F.transform(fresh, lambda x: x["b"]["n"])).alias("conflict_notes"), F.array_compact(F.transform(fresh, lambda x: x["b"]["t"])).alias("tolerated"))


def audit_gold(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD, scorer: Scorer | None = None) -> DataFrame:
    """Both kinds of gold elements; gold and predictions become tables, which both then share."""
    gold = materialize(gold, "coverage-gold")
    pred = pred if "pred_said" in pred.columns else materialize(said(pred, "pred"), "coverage-predictions")
    several = F.size(composite_parts(F.col("name"))) > 1
    return audit_simple(gold.filter(~several), pred, threshold, scorer).unionByName(audit_composite(gold.filter(several), pred, threshold, scorer))


def extras(gold: DataFrame, pred: DataFrame, audits: DataFrame, threshold: float = THRESHOLD, scorer: Scorer | None = None) -> DataFrame:
    """(sample_id, pred_index, pred_name, classification, best_gold_index, best_score) of predictions that cover
    nothing: supported if the nearest gold element shares an object with the name, unsupported if it is near
    but shares none, else for review."""
    used = audits.select("sample_id", F.explode("covering").alias("pred_index")).distinct()
    rest = said(pred, "pred").join(used, ["sample_id", "pred_index"], "left_anti")
    pairs = met(said(gold, "gold"), rest, "right", scorer)[0].withColumns({"score": F.coalesce("score", F.lit(0.0)), "shared": F.coalesce("shared", F.lit(False))})
    best = pairs.groupBy("sample_id", "pred_index", "pred_name").agg(F.max_by(F.struct("gold_index", "score", "shared"), F.struct("score", -F.col("gold_index"))).alias("b"))
    near = (F.col("b.score") >= threshold) & (F.col("b.score") > 0)
    kind = F.when(near & F.col("b.shared"), "supported_extra").when(near, "unsupported_extra").otherwise("needs_review")
    return best.select("sample_id", "pred_index", "pred_name", kind.alias("classification"), F.when(F.col("b.score") > 0, F.col("b.gold_index")).alias("best_gold_index"), F.round("b.score", 3).alias("best_score"))


def audit_all(gold: DataFrame, pred: DataFrame, threshold: float = THRESHOLD, scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, extras) of ``audit_gold`` and ``extras``. Gold, predictions and audits are tables that the
    extras, the audits and the caller read."""
    gold, ready = materialize(gold, "coverage-gold"), materialize(said(pred, "pred"), "coverage-predictions")
    audits = materialize(audit_gold(gold, ready, threshold, scorer), "coverage-audits")
    return audits, extras(gold, ready, audits, threshold, scorer)


def totals(audits: DataFrame, extra: DataFrame, all_gold: int | None = None) -> DataFrame:
    """Counts of gold covered, conflicts, tolerated colours and extras, with the coverage rate of the gold
    evaluated and, if given, of all gold."""
    kinds = ("supported_extra", "unsupported_extra", "needs_review")
    of_gold = audits.select(F.lit(True).alias("gold"), "covered", (F.size("conflict_notes") > 0).alias("conflict"), (F.size("tolerated") > 0).alias("tolerated"), F.lit("").alias("kind"))
    of_extra = extra.select(*[F.lit(False).alias(c) for c in ("gold", "covered", "conflict", "tolerated")], F.col("classification").alias("kind"))
    count = {"gold_count": "gold", "covered_gold_count": "covered", "conflict_count": "conflict", "color_family_tolerated_count": "tolerated"}
    d = of_gold.unionByName(of_extra).agg(*[F.count_if(c).alias(n) for n, c in count.items()], *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds])
    rate = lambda n: F.when(n > 0, F.col("covered_gold_count") / n).otherwise(0.0)
    d = d.withColumn("gold_coverage_rate", rate(F.col("gold_count")))
    return d if all_gold is None else d.withColumn("all_gold_coverage_rate", rate(F.lit(all_gold)))
