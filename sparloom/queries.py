"""Queries of the library's own operators over the driver tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.parsing import lenient_json, rule_location
from sparloom.functions.similarity import sign_bits
from sparloom.functions.tags import source_key
from sparloom.functions.text import char_set, char_similarity, set_jaccard, set_overlap, tokens
from sparloom.operators import alignment, assignment, basics, curation, detection, duplicates, events, fidelity, gold, lanes, quality, queue, scoring
from sparloom.operators.shared import own_dir
from sparloom.streaming import follow

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


BAG = """
WITH n AS (
  SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS p, count(*) FILTER (WHERE event_id % 2 = 1) AS g
  FROM events GROUP BY ALL),
m AS (SELECT event_type, sum(least(p, g)) AS tp, sum(greatest(p - g, 0)) AS fp, sum(greatest(g - p, 0)) AS fn FROM n {by}),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM m)
SELECT {cols} CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s
"""


@query(BAG.format(by="", cols="").replace("SELECT event_type, sum(least", "SELECT sum(least"))
def event_bag_match(spark, sf_dir):
    """Predicted events (even ids) against true ones (odd ids) as bags of user and type, over all."""
    pred, true = _event_sides(spark, sf_dir)
    return events.metrics(events.bag_counts(pred, true, ["user_id", "event_type"]))


@query(BAG.format(by="GROUP BY event_type", cols="event_type,"))
def event_bag_match_by_type(spark, sf_dir):
    pred, true = _event_sides(spark, sf_dir)
    return events.metrics(events.bag_counts(pred, true, ["user_id", "event_type"]), ["event_type"])


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 1)
SELECT coalesce(p.user_id, g.user_id) AS user_id, coalesce(p.event_type, g.event_type) AS event_type,
  CASE WHEN p.event_id IS NULL THEN 'fn' WHEN g.event_id IS NULL THEN 'fp' ELSE 'matched' END AS outcome,
  p.event_id AS pred_id, g.event_id AS gold_id
FROM p FULL JOIN g ON p.user_id = g.user_id AND p.event_type = g.event_type AND p.n = g.n
""")
def event_bag_rows(spark, sf_dir):
    """The pairs and leftovers of the bag match."""
    pred, true = (x.select("event_id", "user_id", "event_type") for x in _event_sides(spark, sf_dir))
    rows = events.bag_match(pred, true, ["user_id", "event_type"], ["event_id"], ["event_id"])
    return rows.select("user_id", "event_type", "outcome", F.col("pred.event_id").alias("pred_id"), F.col("gold.event_id").alias("gold_id"))


@query("""
SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM (SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM (
  SELECT CAST(count_if(n_chars >= 200 AND quality = 1) AS BIGINT) AS tp, CAST(count_if(n_chars >= 200 AND quality = 0) AS BIGINT) AS fp,
    CAST(count_if(n_chars < 200 AND quality = 1) AS BIGINT) AS fn FROM documents JOIN labels USING (doc_id)))
""")
def binary_pred_metrics(spark, sf_dir):
    """A length rule as prediction of quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return events.metrics(events.bag_counts(d.filter("n_chars >= 200"), d.filter("quality = 1"), ["doc_id"]))


def _rules_of_lines(spark, sf_dir) -> DataFrame:
    """Line items as rule rows with three views."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_returnflag").alias("category"), F.concat(F.lit("fabric_"), F.col("l_linenumber").cast("string")).alias("rule_id"),
        F.when(F.col("l_returnflag") == "R", "wrong color").when(F.col("l_returnflag") == "A", "extra").otherwise("correct").alias("front_status"),
        F.when(F.col("l_linestatus") == "O", "wrong material").otherwise("correct").alias("side_status"),
        F.when(F.col("l_quantity") > 45, "wrong shape").otherwise("correct").alias("back_status"),
        F.when(F.col("l_discount") > 0.05, "high").otherwise("0.4").alias("confidence"), F.lit("").alias("reason"),
    )


LINES = """
lines AS (SELECT l_orderkey, l_linenumber, l_returnflag,
  CASE l_returnflag WHEN 'R' THEN 'wrong color' WHEN 'A' THEN 'extra' ELSE 'correct' END AS front,
  CASE WHEN l_linestatus = 'O' THEN 'wrong material' ELSE 'correct' END AS side,
  CASE WHEN l_quantity > 45 THEN 'wrong shape' ELSE 'correct' END AS back,
  CASE WHEN l_discount > 0.05 THEN 'high' ELSE '0.4' END AS confidence FROM lineitem)
"""


@query(f"""
WITH {LINES},
v AS (SELECT l_returnflag, 'front' AS view, front AS s, confidence FROM lines UNION ALL SELECT l_returnflag, 'side', side, confidence FROM lines
  UNION ALL SELECT l_returnflag, 'back', back, confidence FROM lines)
SELECT l_returnflag AS category, view, s AS issue_type, substr(s, 7) AS attribute, count(*) AS n,
  round(sum(CAST(CASE confidence WHEN 'high' THEN 0.95 ELSE 1.0 END AS DOUBLE)), 6) AS confidence
FROM v WHERE s IN ('wrong color', 'wrong material', 'wrong shape') GROUP BY ALL
""")
def view_unpivot_events(spark, sf_dir):
    """Acceptance events by view, counted by category, view and issue."""
    e = events.rule_events(_rules_of_lines(spark, sf_dir))
    return e.groupBy("category", "view", "issue_type", "attribute").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query("""
SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, lang AS value,
  CASE WHEN l.doc_id IS NULL THEN 'missing_audit' WHEN quality = 1 THEN NULL ELSE 'rule_validity_wrong_value' END AS exclude_reason
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def audited_promotion(spark, sf_dir):
    """Documents as gold, their labels as the audit: promoted, or excluded with the reason."""
    d, a = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("text").alias("rule_id"), F.col("lang").alias("value"))
    audit = a.select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("text").alias("rule_id"), F.lit("").alias("category"), F.lit("").alias("atomic_value"), F.when(F.col("quality") == 1, "correct").otherwise("wrong_value").alias("rule_validity"), F.lit("").alias("reason"), F.col("doc_id").alias("_row"))
    ok, out = gold.promote(rows, audit)
    return ok.select("sample_id", "value", F.lit(None).cast("string").alias("exclude_reason")).unionByName(out.select("sample_id", "value", "exclude_reason"))


@query("""
SELECT c_custkey AS sample_id, c_mktsegment AS category, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
  THEN 'needs_rule_mapping' ELSE 'sample_not_in_rule_audit' END AS gap_reason FROM customer
""")
def coverage_gap_flag(spark, sf_dir):
    """Customers as findings; those with orders are audited samples."""
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("category"))
    return gold.coverage_gaps(f, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"))).select("sample_id", "category", "gap_reason")


@query("""
WITH k AS (SELECT p_brand, p_type, max(p_size) AS size FROM part WHERE p_size > 30 GROUP BY ALL),
f AS (SELECT p_type, max(p_size) AS size FROM part GROUP BY ALL)
SELECT p_partkey, coalesce(k.size, f.size) AS size FROM part LEFT JOIN k USING (p_brand, p_type) LEFT JOIN f USING (p_type)
""")
def fallback_key_lookup(spark, sf_dir):
    """Largest size above 30 by brand and type, else the largest of the type."""
    p = table(spark, sf_dir, "part")
    exact = p.filter("p_size > 30").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("size"))
    loose = p.groupBy(F.lit("").alias("p_brand"), "p_type").agg(F.max("p_size").alias("size"))
    return basics.lookup(p.select("p_partkey", "p_brand", "p_type"), exact.unionByName(loose), ["p_brand", "p_type"], ["p_type"], "size").select("p_partkey", "size")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) > 1 AS is_repeat FROM lineitem")
def dup_key_flag(spark, sf_dir):
    """Line items whose part and supplier stand earlier already."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return basics.flag_repeats(line, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).drop("l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def keep_first(spark, sf_dir):
    """The first line item of each part."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return basics.keep_first(line, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("""
WITH c AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 20 AS often FROM events),
q AS (SELECT event_id, concat_ws(';', CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'invalid_event_type:' || event_type END,
  CASE WHEN k IS NULL THEN 'missing_k' END, CASE WHEN value < 1 THEN 'value_too_small' END) AS issues,
  concat_ws(';', CASE WHEN often THEN 'many_events' END, CASE WHEN k > 50 THEN 'large_k:' || k END) AS warnings FROM c)
SELECT event_id, CASE WHEN issues <> '' THEN 'FAIL' WHEN warnings <> '' THEN 'WARN' ELSE 'PASS' END AS qc_status, issues, warnings FROM q
""")
def row_quality_report(spark, sf_dir):
    """Issues and warnings of events, in a fixed order."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    e = basics.numbered(e, ["user_id", "event_type"], ["event_id"])
    issues = [quality.code(~F.col("event_type").isin("click", "view", "purchase"), "invalid_event_type:", F.col("event_type")), quality.code(F.col("k").isNull(), "missing_k"), quality.code(F.col("value") < 1, "value_too_small")]
    warnings = [quality.code(F.col("_n") > 20, "many_events"), quality.code(F.col("k") > 50, "large_k:", F.col("k").cast("string"))]
    return quality.judged(e, issues, warnings).select("event_id", "qc_status", "issues", "warnings")


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 5")
def top_k_by_group(spark, sf_dir):
    """The five customers of each nation with the most money."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return basics.top_k(c, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 5).drop("c_acctbal")


STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)
ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.ALIASES.items()) + "}"


def _tokens_sql(text: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({STOP})), lambda t: coalesce({ALIAS}[t], t)))"


def _aligned_parts(spark, sf_dir, sequences: bool) -> DataFrame:
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("_row"), F.col("p_partkey").cast("string").alias("finding_id"), F.col("p_brand").alias("sample_id"), F.lit("").alias("category"), F.col("p_name").alias("human_rule_name"), F.col("p_type").alias("expected_value"))
    types = p.select(F.col("p_brand").alias("sample_id"), F.col("p_type").alias("rule_id")).distinct()
    rules = basics.numbered(types, ["sample_id"], ["rule_id"], "position").select(F.lit("").alias("category"), "sample_id", "position", "rule_id", F.col("rule_id").alias("value"))
    found, _ = alignment.align(f, rules, top_k=3, sequences=sequences)
    return found.filter("atomic_rule_id <> ''").select(F.col("_row").alias("finding"), F.col("atomic_rule_id").alias("rule"), "rank", "mapping_score", "candidate_match_type")


#: Code points in matching blocks of texts a and b (under 200 long): the longest run of equal ones, the first in a, then in
#: b, and those of what is left on both sides.
MATCHED = """RECURSIVE pairs AS (SELECT row_number() OVER () AS id, a, b FROM (SELECT DISTINCT lower(p_name || ' ' || p_type) AS a, b FROM part JOIN (SELECT DISTINCT p_brand, lower(p_type || ' ' || p_type) AS b FROM part) USING (p_brand))),
ends AS (SELECT id, i, unnest(range(1, length(b) + 1)) AS j, a, b FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM pairs)),
met AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS run FROM ends WHERE substr(a, i, 1) = substr(b, j, 1)),
runs AS (SELECT id, i, j, max(i) OVER (PARTITION BY id, j - i, run) - i + 1 AS n FROM met),
spans AS (
    SELECT id, 1::BIGINT AS alo, length(a) + 1 AS ahi, 1::BIGINT AS blo, length(b) + 1 AS bhi, 0::BIGINT AS size FROM pairs
    UNION ALL
    SELECT id, CASE side WHEN 0 THEN alo ELSE m.i + m.n END, CASE side WHEN 0 THEN m.i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE m.j + m.n END, CASE side WHEN 0 THEN m.j ELSE bhi END, CASE side WHEN 0 THEN m.n ELSE 0 END
    FROM (SELECT *, unnest([0, 1]) AS side FROM (
        SELECT s.id, s.alo, s.ahi, s.blo, s.bhi, arg_min({'i': r.i, 'j': r.j, 'n': least(r.n, s.ahi - r.i, s.bhi - r.j)}, {'n': -least(r.n, s.ahi - r.i, s.bhi - r.j), 'i': r.i, 'j': r.j}) AS m
        FROM spans s JOIN runs r ON r.id = s.id AND r.i >= s.alo AND r.i < s.ahi AND r.j >= s.blo AND r.j < s.bhi GROUP BY s.id, s.alo, s.ahi, s.blo, s.bhi))),
ratios AS (SELECT a, b, 2e0 * sum(size) / (length(a) + length(b)) AS ratio FROM pairs JOIN spans USING (id) GROUP BY id, a, b),
"""


def _aligned_sql(ratio: str = "0e0", more: str = "", before: str = "") -> str:
    return f"""
WITH {before}f AS (SELECT p_partkey, p_brand, lower(p_type) AS h_value, lower(p_name || ' ' || p_type) AS a, {_tokens_sql("p_name || ' ' || p_type")} AS h FROM part),
r AS (SELECT DISTINCT p_brand, p_type FROM part),
r2 AS (SELECT *, lower(p_type || ' ' || p_type) AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS position, {_tokens_sql("p_type || ' ' || p_type")} AS rt FROM r),
x AS (SELECT p_partkey, p_type, position, h, rt, CAST(((len(list_intersect(h, rt)) / len(list_distinct(list_concat(h, rt)))) * 65e-2 + {ratio} * 25e-2
  + CASE WHEN contains(lower(p_type), h_value) THEN 15e-2 ELSE 0e0 END) * 1152921504606846976e0 AS HUGEINT) * 10000 AS e FROM f JOIN r2 USING (p_brand){more}),
d AS (SELECT *, e // 1152921504606846976 AS down, 2 * (e % 1152921504606846976) AS rest FROM x),
s AS (SELECT *, CAST(down + CASE WHEN rest > 1152921504606846976 OR (rest = 1152921504606846976 AND down % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10000 AS mapping_score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY mapping_score DESC, position) AS rank FROM s WHERE mapping_score >= 0.18 QUALIFY rank <= 3)
SELECT p_partkey AS finding, p_type AS rule, CAST(rank AS INTEGER) AS rank, mapping_score,
  CASE WHEN mapping_score >= 0.86 THEN 'exact_match_candidate' WHEN mapping_score >= 0.55 THEN 'semantic_equivalent_candidate'
    WHEN len(list_intersect(h, rt)) IN (len(h), len(rt)) THEN 'broader_or_narrower_candidate'
    WHEN mapping_score >= 0.25 THEN 'related_candidate' ELSE 'low_confidence_candidate' END AS candidate_match_type
FROM k
"""


@query(_aligned_sql())
def align_candidates(spark, sf_dir):
    """The three best of a brand's types for each part, by token overlap and containment."""
    return _aligned_parts(spark, sf_dir, False)


@query(_aligned_sql("ratio", " JOIN ratios USING (a, b)", MATCHED))
def align_candidates_sequences(spark, sf_dir):
    """The same with the ratio of matching character sequences: the whole score."""
    return _aligned_parts(spark, sf_dir, True)


TAG_RULES = {"solo": "p_size > 3", "full_body": "p_size % 4 <> 0", "looking_at_viewer": "p_size % 3 <> 0", "standing": "p_size % 5 = 0", "sitting": "p_size % 7 = 0", "turnaround": "p_size % 2 = 0", "multiple_views": "p_partkey % 3 <> 0", "white_background": "p_partkey % 2 = 0", "sword": "p_partkey % 11 = 0", "armor": "p_partkey % 13 = 0", "tail": "p_partkey % 17 = 0", "hat": "p_partkey % 5 < 2", "dress": "p_partkey % 7 < 3", "smile": "p_partkey % 19 < 9", "official_art": "p_partkey % 23 < 4", "1boy": "p_partkey % 29 < 5", "1girl": "p_partkey % 29 >= 5", "text": "p_partkey % 31 = 0", "bikini": "p_partkey % 37 = 0", "chibi": "p_partkey % 41 = 0", "upper_body": "p_partkey % 43 = 0"}


def _tagged_parts(spark, sf_dir) -> DataFrame:
    tags = F.concat_ws(" ", *[F.when(F.expr(c), t) for t, c in TAG_RULES.items()])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), tags.alias("tags"), F.col("p_size").alias("width"), F.lit(20).alias("height"), F.col("p_retailprice").alias("colorfulness"))


def _scores_sql() -> str:
    has = {f: "(" + " OR ".join(f"({TAG_RULES[t]})" for t in ts if t in TAG_RULES) + ")" if any(t in TAG_RULES for t in ts) else "false" for f, ts in V.FEATURE_TAGS.items()}
    front = f"({TAG_RULES['looking_at_viewer']})"
    has |= {"colorful": "p_retailprice >= 50", "not simple_bg": f"NOT {has['simple_bg']}", "not full_body": f"NOT {has['full_body']}", "full_body, not standing": f"({has['full_body']} AND NOT {has['standing']})", "armor or appendage": f"({has['armor']} OR {has['appendage']})", "simple head goods": f"({has['head_feature']} AND {has['simple_bg']} AND NOT {has['weapon']} AND NOT {has['armor']} AND NOT {has['appendage']})", "wide": "(p_size <> 0 AND p_size / 20 > 1.35)", "tall": "(p_size <> 0 AND p_size / 20 < 0.85)"}
    out = []
    for k, c in enumerate(V.CATEGORIES):
        total = "10" + "".join(f" + CASE WHEN {has[n]} THEN {p[k]} ELSE 0 END" for n, p, _ in scoring.POINTS if p[k])
        last = f"least({total}, -100)" if c in V.BODY_CATEGORIES else f"{total} + 25"
        out.append(f"CASE WHEN NOT {has['full_body']} OR NOT {front} THEN {last} ELSE {total} END AS s{k}")
    return f"SELECT p_partkey AS sample_id, {', '.join(out)} FROM part"


NAMES = "[" + ", ".join(f"'{c}'" for c in V.CATEGORIES) + "]"
ASSIGN_SQL = f"""
WITH s AS ({_scores_sql()}),
o AS (SELECT *, list_sort([{", ".join(f"{{'s': -s{k}, 'k': {k}}}" for k in range(6))}]) AS o FROM s),
n AS (SELECT *, greatest(3, least(4, len(list_filter(o, lambda x: -x.s >= 60)))) AS n FROM o)
SELECT sample_id, {", ".join(f"s{k} AS score_{c}" for k, c in enumerate(V.CATEGORIES))}, {NAMES}[o[1].k + 1] AS primary_category, -o[1].s AS primary_score,
  array_to_string(list_transform(o[1:n], lambda x: {NAMES}[x.k + 1]), '|') AS candidate_categories, o[2].s - o[1].s AS margin,
  o[2].s - o[1].s < 10 OR -o[1].s <= 0 AS review_required FROM n
"""


@query(ASSIGN_SQL)
def additive_scorer(spark, sf_dir):
    """Scores of parts (with tags made of their numbers) by category, candidates, margin and review flag."""
    d = scoring.assign(scoring.score(_tagged_parts(spark, sf_dir)))
    return d.select("sample_id", *[f"score_{c}" for c in V.CATEGORIES], "primary_category", "primary_score", "candidate_categories", "margin", "review_required")


@query(f"""
WITH RECURSIVE s AS ({_scores_sql()}),
o AS (SELECT *, list_sort([{", ".join(f"{{'s': -s{k}, 'k': {k}}}" for k in range(6))}]) AS o FROM s),
r AS (SELECT sample_id, list_transform(o, lambda x: x.k + 1) AS c, row_number() OVER (ORDER BY o[2].s - o[1].s DESC, sample_id) AS n FROM o),
walk AS (
    SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sample_id, CAST(NULL AS BIGINT) AS c, list_transform(range(6), lambda k: CAST(count(*) // 6 + CASE WHEN k < count(*) % 6 THEN 1 ELSE 0 END AS BIGINT)) AS room FROM r
    UNION ALL
    SELECT n, sample_id, c, list_transform(room, lambda v, k: CASE WHEN k = c THEN v - 1 ELSE v END) FROM (
        SELECT r.n, r.sample_id, list_filter(r.c, lambda k: w.room[k] > 0)[1] AS c, w.room FROM walk w JOIN r ON r.n = w.n + 1))
SELECT sample_id, {NAMES}[c] AS assigned FROM walk WHERE n > 0
""")
def quota_assignment(spark, sf_dir):
    """Parts to categories under even quotas, by margin."""
    return scoring.balanced(scoring.score(_tagged_parts(spark, sf_dir)), given=None)


@query(f"""
SELECT p_partkey AS id, CASE WHEN p_size % 13 = 0 THEN 'not_safe' WHEN NOT ({TAG_RULES["turnaround"]}) THEN 'missing_sheet_tag'
  WHEN NOT ({TAG_RULES["multiple_views"]}) AND NOT ({TAG_RULES["solo"]}) THEN 'missing_required_tags:multiple_views,solo'
  WHEN NOT ({TAG_RULES["multiple_views"]}) THEN 'missing_required_tags:multiple_views' WHEN NOT ({TAG_RULES["solo"]}) THEN 'missing_required_tags:solo'
  WHEN {TAG_RULES["chibi"]} THEN 'negative_tags:chibi' WHEN {TAG_RULES["upper_body"]} THEN 'partial_view_tags:upper_body'
  WHEN CAST(trunc(p_retailprice) AS BIGINT) < 450 THEN 'too_small'
  WHEN NOT ({TAG_RULES["hat"]}) THEN 'missing_positive_series_tag'
  WHEN {TAG_RULES["tail"]} THEN 'prefilter_pass;signature_features:tail' ELSE 'prefilter_pass' END AS reason FROM part
""")
def reject_cascade(spark, sf_dir):
    """The first gate that each part, read as a post, does not pass."""
    d = _tagged_parts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), "p_size"), "sample_id")
    pixels = F.floor("colorfulness").cast("string")
    posts = d.select(F.col("sample_id").alias("id"), "tags", F.when(F.col("p_size") % 13 == 0, "explicit").otherwise("safe").alias("rating"), pixels.alias("sample_width"), F.lit(None).cast("string").alias("sample_height"), pixels.alias("width"), pixels.alias("height"), F.lit("").alias("source"), F.lit("sheets").alias("crawl_label"), F.lit("hat turnaround -comic rating:safe").alias("raw_tags"))
    return curation.cascade(posts).select("id", "reason")


@query("""
WITH RECURSIVE open AS (
    SELECT o_orderkey AS o, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, false AS kept FROM orders
    UNION ALL
    SELECT o, c, d, first AS kept FROM (
        SELECT *, bool_or(first) OVER (PARTITION BY c) OR bool_or(first) OVER (PARTITION BY d) AS hit FROM (
            SELECT o, c, d, o = min(o) OVER (PARTITION BY c) AND o = min(o) OVER (PARTITION BY d) AS first FROM open WHERE NOT kept))
    WHERE first OR NOT hit)
SELECT o_orderkey, o_orderkey IN (SELECT o FROM open WHERE kept) AS kept FROM orders
""")
def accept_first(spark, sf_dir):
    """Orders kept if none kept before them has their customer or their day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return curation.accept_first(o, "o_orderkey", ["o_custkey", "day"]).select("o_orderkey", "kept")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) AS group_size, min(doc_id) OVER (PARTITION BY text) AS group_first FROM documents QUALIFY group_size > 1")
def exact_dup_groups(spark, sf_dir):
    """Documents whose text other documents have, by SHA-256."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return duplicates.exact_groups(d, "h", "doc_id").select("doc_id", "group_size", "group_first")


@query(f"SELECT token, count(*) AS n, min(doc_id) AS first_seen FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def token_frequencies(spark, sf_dir):
    """In how many documents each token stands, and the first of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    return basics.frequencies(d, ["token"], "doc_id")


@query("""
WITH h AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS HUGEINT) ELSE 0 END)) AS bits FROM embeddings),
c AS (SELECT bits, min(vec_id) AS class_id, count(*) AS class_size FROM h GROUP BY bits),
l AS (SELECT a.class_id, count(*) AS n FROM c a JOIN c b ON a.class_id <> b.class_id AND bit_count(CAST(xor(a.bits, b.bits) AS HUGEINT)) <= 5 GROUP BY a.class_id)
SELECT vec_id, class_id, class_size, coalesce(n, 0) AS links FROM h JOIN c USING (bits) LEFT JOIN l USING (class_id)
""")
def hamming_links(spark, sf_dir):
    """Vectors by the signs of their elements: the class of equal bits and its links to classes within five bits."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("bits"))
    members, pairs = duplicates.near_pairs(v, "vec_id", "bits")
    links = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    return members.join(links, "class_id", "left").fillna(0, ["links"]).select(F.col("id").alias("vec_id"), "class_id", "class_size", "links")


@query("""
WITH v AS (SELECT vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS HUGEINT) ELSE 0 END)) AS bits FROM embeddings),
m AS (SELECT *, coalesce(list_sum(list_transform(range(0, id % 8), lambda j: CAST(1 AS HUGEINT) << CAST((id + 9 * j) % 64 AS HUGEINT))), 0) AS mask FROM v),
h AS (SELECT 2 * id AS id, bits FROM v UNION ALL SELECT 2 * id + 1, xor(bits, CAST(mask AS HUGEINT)) FROM m),
c AS (SELECT bits, min(id) AS id FROM h GROUP BY bits)
SELECT a.id AS a, b.id AS b, CAST(bit_count(CAST(xor(a.bits, b.bits) AS HUGEINT)) AS INTEGER) AS hamming_distance FROM c a JOIN c b ON a.id < b.id AND bit_count(CAST(xor(a.bits, b.bits) AS HUGEINT)) <= 5
""")
def hamming_pairs(spark, sf_dir):
    """Pairs within five bits of the signs of vectors and of copies in which none to seven of them are turned."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_bits(F.col("embedding")).alias("bits"))
    turned = F.aggregate(F.slice(F.array(*[F.lit(j) for j in range(7)]), F.lit(1), (F.col("id") % 8).cast("int")), F.col("bits"), lambda bits, j: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("id") + 9 * j) % 64).cast("int"))))
    # apart from the new id: in one select, the lambda's ``id`` would be the new one
    copies = v.withColumn("turned", turned).select((2 * F.col("id") + 1).alias("id"), F.col("turned").alias("bits"))
    both = v.select((2 * F.col("id")).alias("id"), "bits").union(copies)
    return duplicates.near_pairs(both, "id", "bits")[1]


def _turns(spark, sf_dir, role: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    return t.select("conv_id", F.col("turn").cast("int").alias("index"), F.col("text").alias("name"), "text")


@query()
def optimal_assignment(spark, sf_dir):
    """User and assistant turns of a conversation in pairs, the total similarity of characters being largest."""
    return assignment.optimal(_turns(spark, sf_dir, "assistant"), _turns(spark, sf_dir, "user"), "conv_id")


#: Similarity s of assistant turn i and user turn j of a conversation, by their distinct characters.
TURN_PAIRS = """c AS (SELECT conv_id, role, CAST(turn AS INTEGER) AS turn, list_distinct(list_filter(string_split(text, ''), lambda c: NOT regexp_matches(c, '^[\\s，。、'':：;；,.!！?？/|（）()\\[\\]{}<>《》-]*$'))) AS x FROM conversations),
s AS (SELECT p.conv_id, p.turn AS i, g.turn AS j, CASE WHEN len(p.x) > 0 AND len(g.x) > 0 THEN greatest(len(list_intersect(p.x, g.x)) / len(list_distinct(list_concat(p.x, g.x))), len(list_intersect(p.x, g.x)) / least(len(p.x), len(g.x))) ELSE 0 END AS s
  FROM c p JOIN c g ON g.conv_id = p.conv_id AND g.role = 'user' WHERE p.role = 'assistant'),
r AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY i) AS step FROM s)"""


@query(f"""
WITH RECURSIVE {TURN_PAIRS},
walk AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS step, CAST([] AS INTEGER[]) AS taken, CAST(0 AS DOUBLE) AS total FROM r
    UNION
    SELECT w.conv_id, w.step + 1, CASE WHEN take THEN list_append(w.taken, r.j) ELSE w.taken END, CASE WHEN take THEN w.total + r.s ELSE w.total END
    FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.step = w.step + 1, (VALUES (true), (false)) AS t(take) WHERE NOT (take AND list_contains(w.taken, r.j))),
n AS (SELECT conv_id, least(count(DISTINCT i), count(DISTINCT j)) AS n, count(DISTINCT i) AS steps FROM s GROUP BY conv_id)
SELECT n.conv_id, n.n AS pairs, round(max(w.total), 9) AS total FROM n JOIN walk w ON w.conv_id = n.conv_id AND w.step = n.steps GROUP BY n.conv_id, n.n
""")
def optimal_totals(spark, sf_dir):
    """The largest total similarity of a conversation's turns in pairs, which the SQL finds among all assignments; the
    pairs are turns of the conversation, each once, and their similarity is what these turns have."""
    a, u = _turns(spark, sf_dir, "assistant"), _turns(spark, sf_dir, "user")
    m = assignment.optimal(a, u, "conv_id", accept=-1.0)
    alike = set_overlap(char_set(F.col("a"), strip_ascii=False), char_set(F.col("u"), strip_ascii=False))
    real = m.join(a.select("conv_id", F.col("index").alias("pred_index"), F.col("text").alias("a")), ["conv_id", "pred_index"]).join(u.select("conv_id", F.col("index").alias("gold_index"), F.col("text").alias("u")), ["conv_id", "gold_index"])
    return real.groupBy("conv_id").agg(F.least(F.countDistinct("pred_index"), F.countDistinct("gold_index"), F.count_if(F.abs(alike - F.col("similarity")) < 1e-12)).alias("pairs"), F.round(F.sum("similarity"), 9).alias("total"))


@query(f"""
WITH RECURSIVE {TURN_PAIRS},
g AS (SELECT conv_id, step, i, j, 3e-1 * s + 7e-1 * s AS gain FROM r),
walk AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS step, CAST([] AS INTEGER[]) AS taken, {{'i': CAST(NULL AS INTEGER), 'j': CAST(NULL AS INTEGER), 'gain': CAST(NULL AS DOUBLE)}} AS best FROM g
    UNION ALL
    SELECT conv_id, step, CASE WHEN best.gain >= 6e-1 THEN list_append(taken, best.j) ELSE taken END, best FROM (
        SELECT w.conv_id, w.step + 1 AS step, w.taken, arg_min({{'i': g.i, 'j': g.j, 'gain': g.gain}}, {{'gain': -g.gain, 'j': g.j}}) FILTER (NOT list_contains(w.taken, g.j)) AS best
        FROM walk w JOIN g ON g.conv_id = w.conv_id AND g.step = w.step + 1 GROUP BY w.conv_id, w.step, w.taken))
SELECT conv_id, best.i AS pred_index, best.j AS gold_index, CAST(-1 AS INTEGER) AS part, best.gain AS similarity FROM walk WHERE best.gain >= 6e-1
""")
def greedy_assignment(spark, sf_dir):
    """The same, taking the best free turn in order."""
    return assignment.greedy(_turns(spark, sf_dir, "assistant"), _turns(spark, sf_dir, "user"), "conv_id")


@query("""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations),
c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[^\\s，。、'':：;；,.!！?？/|（）()\\[\\]{}<>《》-]')) AS a,
  list_distinct(regexp_extract_all(prior, '[^\\s，。、'':：;；,.!！?？/|（）()\\[\\]{}<>《》-]')) AS b FROM t WHERE prior IS NOT NULL),
s AS (SELECT *, len(list_intersect(a, b)) AS n FROM c)
SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(greatest(n / (len(a) + len(b) - n), n / least(len(a), len(b))), 9) ELSE 0 END AS similarity FROM s
""")
def turn_similarity(spark, sf_dir):
    """Similarity of characters of each turn with the one before."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").withColumn("prior", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prior is not null")
    return t.select("conv_id", "turn", F.round(char_similarity(F.col("text"), F.col("prior"), strip_ascii=False), 9).alias("similarity"))


@query(f"""
WITH t AS (SELECT p_partkey, {_tokens_sql("p_name")} AS a, {_tokens_sql("p_type")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 9) AS jaccard FROM t
""")
def token_jaccard(spark, sf_dir):
    """Jaccard similarity of the tokens of a part's name and type."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(set_jaccard(tokens(F.col("p_name")), tokens(F.col("p_type"))), 9).alias("jaccard"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def lenient_json_fields(spark, sf_dir):
    """A field of the properties, fenced or with words around them as a model would answer."""
    e = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" - done."))).otherwise(F.col("props"))
    return e.select("event_id", F.try_variant_get(lenient_json(answer), "$.k", "bigint").alias("k"))


@query("SELECT page_id, regexp_replace(lower(rtrim(regexp_extract(url, 'https?://\\S+'), '/')), '[?#].*$', '') AS source_key FROM pages")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", source_key(F.col("url")).alias("source_key"))


@query(f"""
WITH {LINES},
i AS (SELECT l_orderkey, (front = 'wrong color')::INT + (side = 'wrong material')::INT + (back = 'wrong shape')::INT AS b, (front = 'extra')::INT AS d, confidence = '0.4' AS low FROM lines)
SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, count(*) AS total_rules, CAST(sum(b) AS BIGINT) AS billable, CAST(sum(d) AS BIGINT) AS design, bool_or(low) AS human_review_required,
  CASE WHEN bool_or(low) AND sum(b) = 0 THEN 'unsure' WHEN sum(b) > 0 THEN 'fail' WHEN sum(d) > 0 THEN 'minor_issue' ELSE 'pass' END AS overall_decision FROM i GROUP BY ALL
""")
def lane_decision(spark, sf_dir):
    """Lanes and decision of each order, its lines being the rules."""
    r = _rules_of_lines(spark, sf_dir)
    views = [F.lit("visible").alias(f"{v}_visible") for v in V.VIEWS]
    rule = F.struct("rule_id", F.lit("").alias("value"), views[0], "front_status", views[1], "side_status", views[2], "back_status", F.lit("correct").alias("result"), F.lit("none").alias("issue_type"), "confidence", "reason", F.array().cast("array<struct<view:string,note:string>>").alias("evidence"))
    d = r.groupBy("sample_id").agg(F.collect_list(rule.cast(lanes.RULE)).alias("rules")).withColumn("rules", lanes.normalized(F.col("rules")))
    d = lanes.review(d)
    return d.select("sample_id", F.col("total_rules").cast("long").alias("total_rules"), F.size("billable_issues").cast("long").alias("billable"), F.size("design_notes").cast("long").alias("design"), "human_review_required", "overall_decision")


@query("""
WITH e AS (SELECT l_orderkey, sum(l_quantity * CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END) / sum(l_quantity) AS share FROM lineitem GROUP BY ALL),
p AS (SELECT o_orderkey, 60.0 * share AS element_points, 18.0 + CASE WHEN o_orderstatus <> 'F' THEN 2.0 ELSE 0.0 END AS spec_points,
  CASE WHEN o_orderpriority LIKE '1%' THEN 0.25 ELSE 1.0 END AS identity, CASE WHEN o_orderstatus = 'P' THEN 8.0 ELSE 0.0 END AS penalty FROM orders JOIN e ON l_orderkey = o_orderkey),
t AS (SELECT *, greatest(0, element_points + spec_points + 15 * identity + 4.0 - penalty) AS total FROM p)
SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, round(total, 6) AS total, CASE WHEN identity < 0.5 OR total < 70 THEN 'fail' WHEN total < 85 THEN 'review' ELSE 'pass' END AS label FROM t
""")
def weighted_fidelity(spark, sf_dir):
    """Fidelity of orders, their lines being the assessed elements."""
    line = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "preserved").when(F.col("l_returnflag") == "A", "partial").otherwise("missing")
    items = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("line").alias("name"), F.col("l_quantity").alias("weight"), status.alias("status"), F.lit("seen").alias("evidence"))).alias("element_assessments"))
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    specs = F.create_map(*[x for k in V.SPEC_POINTS for x in (F.lit(k), F.col("o_orderstatus") != "F" if k == "white_background" else F.lit(True))])
    wrong = F.when(F.col("o_orderstatus") == "P", F.array(F.struct(F.lit("x").alias("description"), F.lit("major").alias("severity")))).otherwise(F.array().cast("array<struct<description:string,severity:string>>"))
    records = o.select(F.col("o_orderkey").cast("string").alias("sample_id"), "element_assessments", specs.alias("spec_checks"), F.when(F.col("o_orderpriority").startswith("1"), 0.25).otherwise(1.0).alias("identity_match"), F.lit(0.8).alias("visual_quality"), wrong.alias("hallucinations"))
    return fidelity.scored(records).select("sample_id", F.round("total", 6).alias("total"), "label")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS wrong, CASE WHEN l_linestatus = 'O' THEN 'color' ELSE 'shape' END AS issue,
  count_if(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS n, count_if(l_returnflag = 'R') OVER (PARTITION BY l_orderkey, l_linenumber) AS own
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1),
m AS (SELECT o_orderkey, 1 + o_orderkey % 5 AS target, CASE WHEN o_custkey % 2 = 0 THEN 'color' ELSE 'shape' END AS expected FROM orders)
SELECT expected AS expected_issue_type, count(*) AS total, CAST(count_if(coalesce(wrong, false)) AS BIGINT) AS caught, CAST(count_if(coalesce(wrong AND issue = expected, false)) AS BIGINT) AS issue_matched,
  CAST(sum(CASE WHEN l_linenumber IS NULL THEN 0 ELSE n - own END) AS BIGINT) AS extra_wrong
FROM m LEFT JOIN e ON l_orderkey = o_orderkey AND l_linenumber = target GROUP BY ALL
""")
def targeted_detection(spark, sf_dir):
    """Lines as verdicts, one changed line an order as the target."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = F.col("l_orderkey").cast("string")
    e = line.select(key.alias("sample_id"), detection.target_id(key, F.col("l_linenumber")).alias("element_id"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("position"), F.when(F.col("l_returnflag") == "R", "wrong").otherwise("correct").alias("verdict"), F.when(F.col("l_linestatus") == "O", "color").otherwise("shape").alias("issue_type"))
    m = o.select(F.col("o_orderkey").cast("string").alias("negative_sample_id"), (1 + F.col("o_orderkey") % 5).alias("mutated_element_index"), F.when(F.col("o_custkey") % 2 == 0, "color").otherwise("shape").alias("expected_issue_type"))
    rows = detection.detection(e, m)
    return rows.groupBy("expected_issue_type").agg(F.count("*").alias("total"), F.count_if("caught").alias("caught"), F.count_if("issue_matched").alias("issue_matched"), F.sum("extra_wrong").alias("extra_wrong"))


@query("""
SELECT c.conv_id, c.turn, 'left_only' AS side FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 AND n.role = 'assistant'
WHERE c.role = 'user' AND n.conv_id IS NULL
UNION ALL SELECT n.conv_id, n.turn - 1, 'right_only' FROM conversations n LEFT JOIN conversations c ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 AND c.role = 'user'
WHERE n.role = 'assistant' AND c.conv_id IS NULL
""")
def unanswered_turns(spark, sf_dir):
    """User turns without an answer, and answers without a user turn before them."""
    c = table(spark, sf_dir, "conversations")
    key = F.struct("conv_id", "turn").alias("k")
    asked = c.filter("role = 'user'").select(key)
    given = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn")).select(key)
    return basics.reference_gaps(asked, given, "k").select("k.conv_id", "k.turn", "side")


@query("""
SELECT c_custkey AS sample_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'existing'
  WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'attempted'
  WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'ready'
  WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'atomic_errors' ELSE 'waiting' END AS state FROM customer
""")
def queue_states(spark, sf_dir):
    """Customers in the states of a queue, by what orders they have."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), "o_orderstatus", "o_orderpriority")
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    return queue.partition(s, o.filter("o_orderstatus = 'P'"), o.filter("o_orderpriority like '1%'"), o.filter("o_orderstatus = 'F'"), o)


@query(f"SELECT o_orderkey, {NAMES}[(row_number() OVER (ORDER BY o_orderkey) - 1) % 6 + 1] AS category FROM orders")
def round_robin(spark, sf_dir):
    """Orders to categories in turn, in order of their key."""
    return basics.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", list(V.CATEGORIES))


@query("""
SELECT 'nation' AS signature_type, n_name AS signature, count(*) AS sample_count,
  array_to_string(list_transform(list(s_suppkey ORDER BY s_suppkey)[1:50], lambda x: CAST(x AS VARCHAR)), ' ') AS sample_ids
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1
""")
def signature_groups(spark, sf_dir):
    """Suppliers of one nation, the first fifty ids of each."""
    d = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return duplicates.signature_groups(d, "nation", "n_name", "s_suppkey", "s_suppkey")


@query("SELECT l_orderkey, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned, CAST(count_if(l_discount > 0.05) AS BIGINT) AS discounted, count(*) AS lines FROM lineitem GROUP BY ALL")
def conditional_counts(spark, sf_dir):
    return basics.count_where(table(spark, sf_dir, "lineitem"), ["l_orderkey"], returned=F.col("l_returnflag") == "R", discounted=F.col("l_discount") > 0.05, lines=F.lit(True))


@query("SELECT n_nationkey, count(c_custkey) AS customers, CAST(count_if(c_acctbal < 0) AS BIGINT) AS in_debt FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def dimension_summary(spark, sf_dir):
    """Customers of every nation, also of those without any."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return basics.summary_over(c, table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", customers=F.lit(True), in_debt=F.col("c_acctbal") < 0)


@query("""
SELECT event_type, loc AS location, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'head' WHEN event_id % 3 = 1 THEN 'body' END AS loc FROM events) GROUP BY ALL
""")
def rule_locations(spark, sf_dir):
    """Where rules named after events belong."""
    e = table(spark, sf_dir, "events")
    rid = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("hair_"), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("cape_"), "event_type")).otherwise(F.col("event_type"))
    return e.groupBy("event_type", rule_location(rid).alias("location")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def follow_mode(spark, sf_dir):
    """Event files consumed as a stream until none are left, each event once."""
    schema = table(spark, sf_dir, "events").schema
    base = f"{own_dir(spark)}/follow-{uuid.uuid4().hex}"
    run = follow.follow(spark, f"{sf_dir}/events*.parquet", schema, f"{base}/checkpoint", follow.append_new(f"{base}/rows", "event_id"), "parquet")
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows").select("event_id", "user_id", "event_type", "value")
