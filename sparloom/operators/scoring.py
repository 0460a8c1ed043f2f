"""The additive scorer of product categories, candidates, margins, and assignment under quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.parsing import as_float
from sparloom.functions.tags import has_any, tag_set
from sparloom.functions.text import first_filled, let
from sparloom.operators.shared import materialize

# Points of a feature by category (in the order of V.CATEGORIES) and the reason it leaves.
POINTS: tuple[tuple[str, tuple[int, ...], str | None], ...] = (
    ("solo", (8, 8, 8, 8, 8, 8), "solo"),
    ("simple_bg", (5, 11, 5, 5, 5, 5), "clean_background"),
    ("not simple_bg", (0, -25, -8, -12, 0, 0), None),
    ("colorful", (3, 3, 3, 3, 3, 3), "color_reference"),
    ("full_body", (4, 8, 18, 18, 18, 18), "full_body"),
    ("not full_body", (14, 12, -18, -18, -18, -18), "not_full_body"),
    ("standing", (0, 0, 8, 18, 0, 10), "standing"),
    ("full_body, not standing", (0, 0, 0, -15, 0, 0), None),
    ("sitting", (0, 0, 0, -25, 25, -8), "sitting_pose"),
    ("multi_view", (12, 10, 10, 14, 6, 8), "multi_view_reference"),
    ("head_feature", (20, 18, 10, 8, 5, 0), "distinctive_head"),
    ("outfit", (0, 0, 18, 10, 7, 9), "outfit_reference"),
    ("weapon", (0, -30, -8, -12, -10, 28), "weapon_or_prop"),
    ("armor or appendage", (6, -24, -8, -6, 0, 18), "complex_identity_feature"),
    ("cute", (6, 10, 0, 7, 12, 0), "cute_expression"),
    ("official", (0, 0, 5, 5, 0, 8), "official_or_sheet"),
    ("simple head goods", (0, 16, 0, 0, 0, 0), "simple_head_goods_candidate"),
    ("male", (0, 0, 0, 2, 0, 4), None),
    ("sensitive", (0, -20, -4, -8, -3, 0), "prefer_head_goods_for_sensitive_body"),
    ("text_noise", (-5, -15, -5, -5, -5, -5), "text_noise"),
    ("wide", (3, 0, 3, 4, 0, 0), None),
    ("tall", (0, 0, 0, 0, 3, 4), None),
)
BASE, HEAD_BONUS, BODY_CAP = 10, 25, -100


def features(df: DataFrame) -> dict[str, Column]:
    """Boolean features of a row with sizes, colourfulness and its set of tags in _tags."""
    text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit("")
    tags = F.col("_tags")
    f = {name: has_any(tags, values) for name, values in V.FEATURE_TAGS.items()}
    width, height = (as_float(first_filled(text(f"actual_{c}"), text(c))) for c in ("width", "height"))
    sized = (width != 0) & (height != 0)
    ratio = F.when(sized, width / height)
    f |= {
        "colorful": as_float(text("colorfulness")) >= 50,
        "front_view": has_any(tags, V.FRONT_VIEW_TAGS),
        "not simple_bg": ~f["simple_bg"],
        "not full_body": ~f["full_body"],
        "full_body, not standing": f["full_body"] & ~f["standing"],
        "armor or appendage": f["armor"] | f["appendage"],
        "simple head goods": f["head_feature"] & f["simple_bg"] & ~f["weapon"] & ~f["armor"] & ~f["appendage"],
        "wide": sized & (ratio > 1.35),
        "tall": sized & (ratio < 0.85),
    }
    return f


def score(df: DataFrame) -> DataFrame:
    """``df`` with score_<category>, reason and key_tags."""
    df = df.withColumn("_tags", tag_set(F.col("tags").cast("string") if "tags" in df.columns else F.lit("")))
    found = features(df)
    flagged = df.withColumn("_f", F.struct(*[F.coalesce(c, F.lit(False)).alias(n.replace(" ", "_").replace(",", "")) for n, c in found.items()]))
    has = lambda n: F.col("_f." + n.replace(" ", "_").replace(",", ""))
    shut_out = ~has("full_body") | ~has("front_view")
    out = {}
    for k, category in enumerate(V.CATEGORIES):
        total = reduce(lambda a, p: a + F.when(has(p[0]), p[1][k]).otherwise(0) if p[1][k] else a, POINTS, F.lit(BASE))
        last = F.least(total, F.lit(BODY_CAP)) if category in V.BODY_CATEGORIES else total + HEAD_BONUS
        out[f"score_{category}"] = F.when(shut_out, last).otherwise(total)
    reasons = [F.when(has(n), F.lit(r)) for n, _, r in POINTS if r]
    reasons.append(F.when(~has("full_body"), F.lit("head_only_only_not_full_body")).when(~has("front_view"), F.lit("head_only_only_no_front_view")))
    useful = F.array_intersect(F.array(*map(F.lit, V.KEY_TAGS)), "_tags")
    return flagged.withColumns({**out, "reason": F.array_join(F.array_compact(F.array(*reasons)), ";"), "key_tags": F.array_join(useful, " ")}).drop("_f", "_tags")


def ranked(categories=V.CATEGORIES, prefix: str = "score_") -> Column:
    """Array of (negative score, place, category), best first, ties by place."""
    return F.array_sort(F.array(*[F.struct((-F.col(prefix + c)).alias("s"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(categories)]))


def candidates(order: Column, enough: int = 60, least: int = 3, most: int = 4) -> Column:
    """Categories of ``enough`` points, at least three, at most four."""
    return let(order, lambda o: F.transform(F.slice(o, F.lit(1), F.greatest(F.lit(least), F.least(F.lit(most), F.size(F.filter(o, lambda x: -x["s"] >= enough))))), lambda x: x["c"]))


def margin(order: Column) -> Column:
    return F.get(order, F.lit(1))["s"] - F.get(order, F.lit(0))["s"]


def assign(scored: DataFrame) -> DataFrame:
    """Adds primary_category, primary_score, candidate_categories, margin and review_required."""
    o = F.col("_o")
    d = scored.withColumn("_o", ranked())
    first = F.get(o, F.lit(0))
    return d.withColumns({"primary_category": first["c"], "primary_score": -first["s"], "candidate_categories": F.array_join(candidates(o), "|"), "margin": margin(o), "review_required": (margin(o) < 10) | (-first["s"] <= 0)}).drop("_o")


def balanced(df: DataFrame, id_col: str = "sample_id", given: str | None = "already_generated_category", categories=V.CATEGORIES, prefix: str = "score_") -> DataFrame:
    """(id, assigned): rows in order of margin, largest first, then id, take their best category with room left.
    Room: rows / categories, the first ones get the remainder, less what is given already.

    A row's choice changes only where a category fills up, which happens at most once a category. So the rows
    before the next filling are settled together: per round one count by range of the order and one look into
    a single range for the row that takes the last place. Rows are sorted once, in ranges; none are collected."""
    spark = df.sparkSession
    own = F.coalesce(F.nullif(F.col(given), F.lit("")), F.lit(None)) if given and given in df.columns else F.lit(None).cast("string")
    base = df.select(F.col(id_col).alias("id"), own.alias("given"), ranked(categories, prefix).alias("o"))
    n = base.groupBy("given").agg(F.count("*").alias("n")).collect()
    total, taken = sum(r["n"] for r in n), {r["given"]: r["n"] for r in n}
    room = {c: max(0, total // len(categories) + (k < total % len(categories)) - taken.get(c, 0)) for k, c in enumerate(categories)}
    order = (F.desc("m"), F.asc("id"))
    rows = base.filter("given is null").select("id", F.transform("o", lambda x: x["c"]).alias("o"), margin(F.col("o")).alias("m"))
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "balance")
    steps: list[tuple[int, list[str]]] = []
    at, full = -1, [c for c in categories if room[c] == 0]
    while len(full) < len(categories):
        pick = F.filter("o", lambda c: ~c.isin(*full) if full else F.lit(True))[0]  # noqa: B023
        left = rows.filter(F.col("pos") > at).select("pos", F.shiftright("pos", 33).alias("range"), pick.alias("c"))
        found = left.groupBy("c", "range").agg(F.count("*").alias("n")).orderBy("c", "range").collect()
        ends: list[int] = []
        for c in (c for c in categories if c not in full):
            before = 0
            for r in (r for r in found if r["c"] == c):
                if before + r["n"] >= room[c]:
                    ends.append(left.filter((F.col("range") == r["range"]) & (F.col("c") == c)).select("pos").orderBy("pos").limit(room[c] - before).agg(F.max("pos")).first()[0])
                    break
                before += r["n"]
        stop = min(ends, default=None)
        steps.append((stop if stop is not None else 1 << 62, list(full)))
        if stop is None:
            break
        used = {r["c"]: r["n"] for r in left.filter(F.col("pos") <= stop).groupBy("c").agg(F.count("*").alias("n")).collect()}
        for c, k in used.items():
            room[c] -= k
        at, full = stop, [c for c in categories if room[c] <= 0]
    choice = F.coalesce(*[F.when(F.col("pos") <= stop, F.filter("o", lambda c: ~c.isin(*shut) if shut else F.lit(True))[0]) for stop, shut in steps], F.lit(None).cast("string"))  # noqa: B023
    settled = rows.select("id", choice.alias("assigned")) if steps else spark.createDataFrame([], rows.select("id", F.lit("").alias("assigned")).schema)
    return settled.unionByName(base.filter("given is not null").select("id", F.col("given").alias("assigned"))).withColumnRenamed("id", id_col)
