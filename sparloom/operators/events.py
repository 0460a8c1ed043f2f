"""Events of rules by view, the bag match of two event tables, and precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.parsing import event_confidence, inferred_attribute
from sparloom.functions.text import first_filled
from sparloom.operators.basics import numbered

STRICT = ("sample_id", "category", "issue_type", "rule_id", "view")
RELAXED = ("sample_id", "category", "issue_type", "element_name")


def by_view(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, view, visible, status): one for each of the three views."""
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"{v}_visible").alias("visible") if f"{v}_visible" in df.columns else F.lit("").alias("visible"), F.col(f"{v}_status").alias("status")) for v in V.VIEWS])
    return df.select(*keep, F.inline(views))


def rule_events(rows: DataFrame, number_confidence: bool = False) -> DataFrame:
    """Acceptance events of rule rows with a status by view: predictions, or gold brought to the same form."""
    have = [c for c in ("sample_id", "category", "rule_id", "confidence", "reason") if c in rows.columns]
    long = by_view(rows, have).filter(F.col("status").isin(*V.ACCEPTANCE_ISSUES))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    confidence = event_confidence(F.col("confidence"), number_confidence) if "confidence" in have else F.lit(1.0)
    return long.select(text("sample_id").alias("sample_id"), text("category").alias("category"), "view", F.col("status").alias("issue_type"), text("rule_id").alias("rule_id"), inferred_attribute(text("rule_id"), F.col("status")).alias("attribute"), text("rule_id").alias("element_name"), confidence.alias("confidence"), text("reason").alias("reason"))


def finding_events(rows: DataFrame) -> DataFrame:
    """Acceptance events of rows that carry one issue each; a missing view is unknown, a missing element is
    the rule."""
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in rows.columns else F.lit(d)
    return rows.filter(F.col("issue_type").isin(*V.ACCEPTANCE_ISSUES)).select(text("sample_id").alias("sample_id"), text("category").alias("category"), text("view", "unknown").alias("view"), "issue_type", text("rule_id").alias("rule_id"), text("attribute").alias("attribute"), first_filled(text("element_name"), text("rule_id")).alias("element_name"), event_confidence(text("confidence", "1.0")).alias("confidence"), text("reason").alias("reason"))


def bag_match(pred: DataFrame, gold: DataFrame, keys: list[str], pred_order: list, gold_order: list) -> DataFrame:
    """Rows (keys, outcome, pred, gold): the i-th prediction of a key pairs with its i-th gold row; what is
    left over is fp or fn. A key's rows are numbered by a window, so a key should not hold a large share of
    all rows; ``bag_counts`` has no such limit."""
    p = numbered(pred.select(*keys, F.struct(*pred.columns).alias("pred"), *[F.expr("1").alias("_p")], *_order(pred_order)), keys, [f"_o{i}" for i in range(len(pred_order))]).select(*keys, "pred", "_n")
    g = numbered(gold.select(*keys, F.struct(*gold.columns).alias("gold"), *_order(gold_order)), keys, [f"_o{i}" for i in range(len(gold_order))]).select(*keys, "gold", "_n")
    outcome = F.when(F.col("pred").isNull(), "fn").when(F.col("gold").isNull(), "fp").otherwise("matched")
    return p.join(g, [*keys, "_n"], "full_outer").select(*keys, outcome.alias("outcome"), "pred", "gold")


def _order(order: list) -> list[Column]:
    return [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]


def bag_counts(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn) of the bag match, from counts alone: one aggregate over both tables, combined before
    the shuffle, whatever the size of a key."""
    both = pred.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("g")))
    n = both.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    return n.select(*keys, F.least("p", "g").alias("tp"), F.greatest(F.col("p") - F.col("g"), F.lit(0)).alias("fp"), F.greatest(F.col("g") - F.col("p"), F.lit(0)).alias("fn"))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1")]


def metrics(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summed outcomes and scores, by the given columns or over all."""
    summed = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    total = counts.groupBy(*by).agg(*summed) if by else counts.agg(*summed)
    return total.select(*(by or []), "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def compare(pred: DataFrame, gold: DataFrame, samples: DataFrame | None = None, strict: bool = True, missing_as_fn: bool = False) -> tuple[DataFrame, DataFrame]:
    """(metrics by sample, metrics over all) of two event tables. Unless ``missing_as_fn``, gold of samples
    without predictions counts for nothing; ``samples``: the samples that have predictions, also silent ones."""
    keys = list(STRICT if strict else RELAXED)
    if not missing_as_fn:
        seen = (samples if samples is not None else pred).select("sample_id", "category").distinct()
        gold = gold.join(seen, ["sample_id", "category"], "left_semi")
    counts = bag_counts(pred, gold, keys)
    return metrics(counts, ["category", "sample_id"]), metrics(counts)
