"""The way from annotated tables to scores, as one lazy plan: promotion, events, bag match, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparloom.operators import events, gold


@dataclass
class Scores:
    verified: DataFrame
    excluded: DataFrame
    gold_events: DataFrame
    pred_events: DataFrame
    by_sample: DataFrame
    overall: DataFrame


def score_predictions(annotated: DataFrame, audit: DataFrame, predictions: DataFrame, strict: bool = True, allow_unaudited: bool = False, missing_as_fn: bool = False) -> Scores:
    """Scores of predicted rules (sample_id, category, rule_id, statuses by view) against audited gold. Gold has
    one issue by view, out of its statuses, so that both sides have the same keys."""
    verified, excluded = gold.promote(annotated, audit, allow_unaudited)
    gold_events, pred_events = events.rule_events(verified), events.rule_events(predictions)
    by_sample, overall = events.compare(pred_events, gold_events, predictions, strict, missing_as_fn)
    return Scores(verified, excluded, gold_events, pred_events, by_sample, overall)
