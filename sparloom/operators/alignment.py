"""Alignment of findings with rules: the best candidates of each finding and the review queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions.parsing import rounded
from sparloom.functions.similarity import sequence_ratio
from sparloom.functions.text import FINDING_TEXT, append_once, finding_text, first_filled, set_jaccard, tokens
from sparloom.operators.shared import materialize

MIN_SCORE, TOP_K = 0.18, 5
EXACT, SEMANTIC, RELATED = 0.86, 0.55, 0.25
W_TOKENS, W_SEQUENCE, BONUS = 0.65, 0.25, 0.15


def tier(score: Column, a: Column, b: Column) -> Column:
    """Name of a candidate's strength; a and b: token arrays."""
    contained = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (
        F.when(score >= EXACT, "exact_match_candidate")
        .when(score >= SEMANTIC, "semantic_equivalent_candidate")
        .when(contained, "broader_or_narrower_candidate")
        .when(score >= RELATED, "related_candidate")
        .otherwise("low_confidence_candidate")
    )


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")


def scored_pairs(findings: DataFrame, rules: DataFrame, sequences: bool = True, scorer: Callable[[Column, Column], Column] = sequence_ratio) -> DataFrame:
    """Pairs of a finding (with _finding, an id of the row) and a rule of its sample, scored. Token sets are
    made once a row on each side; the pairs are an equality join on the sample, whose rules are few. Rules by
    category and sample come before rules by sample alone. ``scorer``: the similarity of two texts that is the
    sequence term. Scores are rounded by their binary value, ties to even."""
    f = findings.select("_finding", _text(findings, "category").alias("category"), _text(findings, "sample_id").alias("sample_id"), finding_text(findings.columns).alias("h_text"), F.lower(first_filled(_text(findings, "expected_value"), _text(findings, "expected_from_2d"))).alias("h_value"))
    f = f.withColumn("h_tokens", tokens(F.col("h_text")))
    r = rules.select(_text(rules, "category").alias("category"), "sample_id", "position", "rule_id", "value", F.concat_ws(" ", "rule_id", "value").alias("r_text"))
    r = r.withColumn("r_tokens", tokens(F.col("r_text")))
    exact = f.join(r, ["category", "sample_id"])
    rest = f.join(r.select("category", "sample_id").distinct(), ["category", "sample_id"], "left_anti")
    loose = rest.join(r.filter("category = ''").drop("category"), "sample_id")
    pairs = exact.unionByName(loose)
    both = (F.size("h_tokens") > 0) & (F.size("r_tokens") > 0)
    pairs = pairs.withColumns({"jaccard": F.when(both, set_jaccard(F.col("h_tokens"), F.col("r_tokens"))).otherwise(0.0), "bonus": F.when((F.col("h_value") != "") & (F.col("value") != "") & F.contains(F.lower("value"), F.col("h_value")), BONUS).otherwise(0.0)})
    sequence = scorer(F.lower("h_text"), F.lower("r_text")) if sequences else F.lit(0.0)
    pairs = pairs.withColumn("sequence", sequence)
    score = F.when(both, rounded(F.col("jaccard") * W_TOKENS + F.col("sequence") * W_SEQUENCE + F.col("bonus"), 4)).otherwise(0.0)
    overlap = F.size(F.array_intersect("h_tokens", "r_tokens"))
    reason = F.when(both, F.format_string("token_overlap=%d;jaccard=%.3f;sequence=%.3f;value_bonus=%.2f", overlap, "jaccard", "sequence", "bonus")).otherwise("empty_tokens")
    return pairs.withColumns({"mapping_score": score, "mapping_reason": reason}).withColumn("candidate_match_type", tier(F.col("mapping_score"), F.col("h_tokens"), F.col("r_tokens")))


def align(findings: DataFrame, rules: DataFrame, top_k: int = TOP_K, min_score: float = MIN_SCORE, sequences: bool = True, scorer: Callable[[Column, Column], Column] = sequence_ratio) -> tuple[DataFrame, DataFrame]:
    """(candidates, review queue). Findings of one sample that say the same are scored once. Ties keep the order of
    the rules; a finding without candidates gives one row that says so; several high scores of one finding are a warning on all its rows."""
    f = findings.withColumn("_finding", F.struct(*[_text(findings, c).alias(c) for c in ("category", "sample_id", *FINDING_TEXT) if c in findings.columns]))
    pairs = scored_pairs(f.select("_finding").distinct().select("_finding", "_finding.*"), rules, sequences, scorer)
    has_rules = pairs.select("_finding", F.lit(True).alias("_rules")).distinct()
    rank = Window.partitionBy("_finding").orderBy(F.desc("mapping_score"), "position")
    kept = pairs.filter(F.col("mapping_score") >= min_score).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top_k)
    high = F.count_if(F.col("mapping_score") >= SEMANTIC).over(Window.partitionBy("_finding"))
    kept = materialize(kept.select("_finding", "rank", F.col("rule_id").alias("atomic_rule_id"), F.col("value").alias("atomic_rule_value"), "candidate_match_type", "mapping_score", "mapping_reason", (F.col("mapping_score") < SEMANTIC).alias("needs_review"), high.alias("_high")), "aligned")
    out = f.join(kept, "_finding", "left").join(has_rules, "_finding", "left")
    none = F.when(F.col("_rules"), "no_candidate_above_min_score").otherwise("no_atomic_rules_for_sample")
    out = out.select(
        "_row", F.coalesce("rank", F.lit(1)).alias("rank"), _text(f, "sample_id").alias("sample_id"), _text(f, "category").alias("category"), _text(f, "finding_id").alias("human_finding_id"),
        first_filled(_text(f, "human_rule_name"), _text(f, "feature_key")).alias("human_rule_name"), first_filled(_text(f, "element_name"), _text(f, "feature_key")).alias("human_element_name"), _text(f, "attribute").alias("human_attribute"), first_filled(_text(f, "expected_value"), _text(f, "expected_from_2d")).alias("human_value"),
        F.coalesce("atomic_rule_id", F.lit("")).alias("atomic_rule_id"), F.coalesce("atomic_rule_value", F.lit("")).alias("atomic_rule_value"), F.coalesce("candidate_match_type", F.lit("no_match_candidate")).alias("candidate_match_type"), F.coalesce("mapping_score", F.lit(0.0)).alias("mapping_score"), F.coalesce("mapping_reason", none).alias("mapping_reason"), F.coalesce("needs_review", F.lit(True)).alias("needs_review"),
        F.when((_text(f, "finding_id") != "") & (F.col("_high") > 1), append_once(F.lit(""), F.lit("multiple_high_confidence_candidates"))).otherwise("").alias("warnings"),
    )
    return out, out.filter(F.col("needs_review") | (F.col("candidate_match_type") != "exact_match_candidate"))
