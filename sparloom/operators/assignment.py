"""One-to-one matching of predicted and gold elements within a sample: optimal and greedy. A sample's elements
are a handful, so each is one small matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.functions.text import char_set, compound_halves

ACCEPT, GOOD = 0.50, 0.65
GREEDY, RELAXED, W_NAME, W_TEXT, SPLIT = 0.6, 0.6, 0.3, 0.7, 0.75


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one assignment with the largest sum, by shortest augmenting paths."""
    cost = -gain if gain.shape[0] <= gain.shape[1] else -gain.T
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[at]:
            used[at] = True
            reduced = cost[row_of[at] - 1] - u[row_of[at]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], at
            free = np.where(used[1:], np.inf, least[1:])
            step, to = free.min(), int(free.argmin()) + 1
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
        while at:
            row_of[at], at = row_of[came[at]], came[at]
    pairs = [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return sorted(pairs if gain.shape[0] <= gain.shape[1] else [(j, i) for i, j in pairs])


def char_similarity(a: list[str], b: list[str]) -> float:
    """set_overlap of two lists of distinct characters."""
    x, y = set(a or ()), set(b or ())
    if not x or not y:
        return 0.0
    shared = len(x & y)
    return max(shared / len(x | y), shared / min(len(x), len(y)))


def _comparable(df: DataFrame, columns: list[str], vectors: bool) -> DataFrame:
    """Texts as their distinct characters, by the one rule of ``functions.text``; vectors as they are."""
    return df if vectors else df.withColumns({c: char_set(F.col(c), strip_ascii=False) for c in columns})


def vector_similarity(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size else 0.0


def similar(a: list, b: list, by: Callable = char_similarity) -> np.ndarray:
    return np.array([[by(x, y) for y in b] for x in a]).reshape(len(a), len(b))


def _by_sample(pred: DataFrame, gold: DataFrame, key: str, pred_fields: list[str], gold_fields: list[str]) -> DataFrame:
    """(key, p, g): both sides' elements of a sample as arrays in order. Lists of a handful of elements are one
    row, so that a task works through many samples in one Arrow batch instead of one call a sample."""
    listed = lambda d, fields, name: d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return listed(pred, pred_fields, "p").join(listed(gold, gold_fields, "g"), key)


def _solved(pairs: DataFrame, key: str, kind: str, solve: Callable[[list, list], list[tuple]], columns: dict[str, pa.DataType]) -> DataFrame:
    """Rows (key, columns) that ``solve`` gives for the arrays of each sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (p, g) in enumerate(zip(batch.column("p").to_pylist(), batch.column("g").to_pylist(), strict=True)):
                found = solve(p, g)
                at += [k] * len(found)
                rows += found
            made = [pa.array([r[c] for r in rows], t) for c, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *made], names=[key, *columns])

    names = {pa.int32(): "int", pa.float64(): "double", pa.string(): "string"}
    return pairs.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} {names[t]}" for c, t in columns.items()))


def optimal(pred: DataFrame, gold: DataFrame, key: str, text: str = "text", vectors: bool = False, accept: float = ACCEPT) -> DataFrame:
    """(key, pred_index, gold_index, similarity, match_quality): the assignment of each sample with the largest
    total similarity, as far as a pair reaches ``accept``. Both sides: key, index and ``text`` (or a vector)."""
    by = vector_similarity if vectors else char_similarity

    def solve(p: list, g: list) -> list[tuple]:
        gain = similar([x[text] for x in p], [x[text] for x in g], by)
        return [(p[i]["index"], g[j]["index"], float(gain[i, j]), "good" if gain[i, j] >= GOOD else "weak") for i, j in best_assignment(gain) if gain[i, j] >= accept]

    pairs = _by_sample(_comparable(pred, [text], vectors), _comparable(gold, [text], vectors), key, ["index", text], ["index", text])
    return _solved(pairs, key, gold.schema[key].dataType.simpleString(), solve, {"pred_index": pa.int32(), "gold_index": pa.int32(), "similarity": pa.float64(), "match_quality": pa.string()})


def expand_compounds(gold: DataFrame, halves_differ) -> DataFrame:
    """Gold candidates: every element and, where a name has two halves that differ (a column, e.g. a cosine
    below 0.75), a virtual one for each half. Adds candidate (order), is_virtual and part."""
    halves = F.when(halves_differ, compound_halves(F.col("name"))).otherwise(F.array().cast("array<string>"))
    own = F.array(F.struct(F.lit(-1).alias("part"), F.col("name").alias("name")))
    parts = F.transform(halves, lambda h, i: F.struct(i.alias("part"), h.alias("name")))
    one = gold.withColumn("_c", F.explode(F.concat(own, parts)))
    return one.withColumns({"name": F.col("_c.name"), "part": F.col("_c.part"), "is_virtual": F.col("_c.part") >= 0}).drop("_c")


def greedy(pred: DataFrame, gold: DataFrame, key: str, name: str = "name", text: str = "text", vectors: bool = False, accept: float = GREEDY) -> DataFrame:
    """(key, pred_index, gold_index, part, similarity): predictions in order take the best free candidate;
    ties and non-positive similarities leave the earlier one. Candidates: index and part (see
    expand_compounds; without parts, -1)."""
    gold = gold if "part" in gold.columns else gold.withColumn("part", F.lit(-1))

    by = vector_similarity if vectors else char_similarity

    def solve(p: list, g: list) -> list[tuple]:
        gain = W_NAME * similar([x[name] for x in p], [x[name] for x in g], by) + W_TEXT * similar([x[text] for x in p], [x[text] for x in g], by)
        free, rows = np.ones(len(g), bool), []
        for i in range(len(p)):
            left = np.where(free, gain[i], 0.0)
            j = int(left.argmax())
            if left[j] > 0 and left[j] >= accept:
                free[j] = False
                rows.append((p[i]["index"], g[j]["index"], g[j]["part"], float(gain[i, j])))
        return rows

    fields = list(dict.fromkeys(["index", name, text]))
    both = list(dict.fromkeys([name, text]))
    pairs = _by_sample(_comparable(pred, both, vectors), _comparable(gold, both, vectors), key, fields, list(dict.fromkeys(["index", "part", name, text])))
    return _solved(pairs, key, gold.schema[key].dataType.simpleString(), solve, {"pred_index": pa.int32(), "gold_index": pa.int32(), "part": pa.int32(), "similarity": pa.float64()})


def evaluate(matches: DataFrame, pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Per sample of either side: counts, coverage, precision, F1, mean similarity, good and weak matches.
    A side without elements counts as 1."""
    n = pred.groupBy(key).agg(F.count("*").alias("pred_count")).join(gold.groupBy(key).agg(F.count("*").alias("gold_count")), key, "full_outer")
    quality = F.col("match_quality") if "match_quality" in matches.columns else F.when(F.col("similarity") >= GOOD, "good").otherwise("weak")
    m = matches.groupBy(key).agg(F.count("*").alias("matched"), F.avg("similarity").alias("avg_similarity"), F.count_if(quality == "good").alias("good_matches"))
    d = n.join(m, key, "left").fillna(0)
    coverage = F.when(F.col("gold_count") > 0, F.col("matched") / F.col("gold_count")).otherwise(1.0)
    precision = F.when(F.col("pred_count") > 0, F.col("matched") / F.col("pred_count")).otherwise(1.0)
    d = d.withColumns({"coverage": coverage, "precision": precision, "weak_matches": F.col("matched") - F.col("good_matches")})
    return d.withColumn("f1", F.when(F.col("coverage") + F.col("precision") > 0, 2 * F.col("coverage") * F.col("precision") / (F.col("coverage") + F.col("precision"))).otherwise(0.0))


def overall(samples: DataFrame) -> DataFrame:
    """Means of the samples' metrics, ratios of sums (micro), and the range of mean similarity over samples
    with a match."""
    some = F.when(F.col("matched") > 0, F.col("avg_similarity"))
    ratio = lambda n: F.when(F.sum(n) > 0, F.sum("matched") / F.sum(n)).otherwise(0.0)
    return samples.agg(F.count("*").alias("samples"), F.avg("coverage").alias("mean_coverage"), F.avg("precision").alias("mean_precision"), F.avg("f1").alias("mean_f1"), ratio("gold_count").alias("micro_coverage"), ratio("pred_count").alias("micro_precision"), F.avg(some).alias("mean_similarity"), F.min(some).alias("min_similarity"), F.max(some).alias("max_similarity"))


def compound_coverage(matches: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, gold_index, coverage) of gold elements: 1 if matched itself, else the share of its parts matched."""
    total = candidates.groupBy(key, F.col("index").alias("gold_index")).agg(F.count_if("is_virtual").alias("parts"))
    got = matches.groupBy(key, "gold_index").agg(F.bool_or(F.col("part") < 0).alias("direct"), F.count("*").alias("n"))
    credit = F.when(F.col("direct"), 1.0).when(F.col("n") > 0, F.least(F.lit(1.0), F.col("n") / F.greatest("parts", F.lit(1)))).otherwise(0.0)
    return total.join(got, [key, "gold_index"], "left").select(key, "gold_index", credit.alias("coverage"))


def relaxed_matches(pred: DataFrame, gold: DataFrame, matches: DataFrame, key: str, similarity, threshold: float = RELAXED) -> DataFrame:
    """Unmatched predictions that some gold element of their sample resembles; ``similarity``: a column of
    p_* and g_* columns."""
    left = pred.join(matches.select(key, F.col("pred_index").alias("index")), [key, "index"], "left_anti")
    p = left.select(key, *[F.col(c).alias(f"p_{c}") for c in left.columns if c != key])
    g = gold.select(key, *[F.col(c).alias(f"g_{c}") for c in gold.columns if c != key])
    near = p.join(g, key).filter(similarity >= threshold).select(key, F.col("p_index").alias("index")).distinct()
    return left.join(near, [key, "index"], "left_semi")


def category_precision(pred: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Per category of predictions: all, matched, precision and mean similarity, over the categories of both."""
    got = matches.join(pred.select(key, F.col("index").alias("pred_index"), "category"), [key, "pred_index"]).groupBy("category").agg(F.count("*").alias("matched"), F.avg("similarity").alias("avg_similarity"))
    total = pred.groupBy("category").agg(F.count("*").alias("total_pred"))
    d = total.join(got, "category", "full_outer").fillna(0)
    return d.withColumn("precision", F.when(F.col("total_pred") > 0, F.col("matched") / F.col("total_pred")).otherwise(0.0))
