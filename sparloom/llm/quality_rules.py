"""Quality rules at the level of hosts.

Each document is held against a few rules; failures are counted by host (the source of a document, or
any column given); each rule's failure rates are shrunk towards an empirical beta prior fitted to all
hosts by moments; a host whose shrunk rate of any rule, less the standard deviation that its number of documents
leaves, is above that rule's limit is rejected, and that verdict is joined back to its documents. The limit follows
from the prior, SPREAD of its standard deviations above its mean, between MIN_RATE and MAX_RATE: a host is rejected
for being unlike the others, never for a rate that is small in itself, always for breaking a rule in clearly more
than half of its documents. A document stays if it passes every rule itself and its host
stands.

Only DataFrame functions are used. Tokens are never exploded: word windows are hashed, compared and
counted inside the row; one aggregate over hosts moves a few numbers a host.

Defined results: null and empty texts have no words (and so fail the length rule); a null host is a host
of its own; repeated ids are rows of their own; an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import SPACES, UPPER, count_chars, fresh_name, let, materialize, without_keys, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: The limit of a rule's rate: this many standard deviations over the mean, within these bounds.
SPREAD, MIN_RATE, MAX_RATE = 3.0, 0.2, 0.5
#: Weight of the prior where hosts give no variance to fit it from.
PLAIN_STRENGTH = 10.0
RULES = ("short", "repeats", "symbols", "lines", "shout")


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, in O(n log n): equal hashes stand side by side
    once sorted, and the starts found, in order, cover at most ``window`` new words each."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twins = let(by_hash, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))))
        starts = F.sort_array(F.transform(twins, lambda e: e["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)]))
    return F.when(F.size(ws) < window, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def measures(text: Column) -> Column:
    """Struct of the counts that the rules use."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), count_chars(text, SYMBOLS).alias("n_symbols"), n_dup.alias("n_dup_lines"), repeated_words(ws).alias("n_repeat_words"), count_chars(text, UPPER).alias("n_upper")))


def rules(m: Column) -> dict[str, Column]:
    """Rule failures of a document by its measures."""
    n = m["n_words"]
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > 20 * n,
        "symbols": 10 * m["n_symbols"] > n,
        "lines": (m["n_dup_lines"] >= 2) & (m["n_dup_lines"] * 20 > n),
        "shout": 2 * m["n_upper"] > m["word_chars"],
    }


def host_verdicts(flags: DataFrame, spread: float = SPREAD, min_rate: float = MIN_RATE, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, host_docs, rate of each rule, host_ok) from rows (host, one boolean a rule).

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates, less
    the variance that drawing documents explains."""
    hosts = flags.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.count_if(r).alias(r) for r in RULES])
    rate = {r: F.col(r) / F.col("host_docs") for r in RULES}
    moments = hosts.agg(*[x for r in RULES for x in (F.avg(rate[r]).alias(f"{r}_m"), F.var_pop(rate[r]).alias(f"{r}_v"))], F.avg(1 / F.col("host_docs")).alias("inv")).first()
    shrunk, ok = [], []
    for r in RULES:
        mean, found = moments[f"{r}_m"] or 0.0, (moments[f"{r}_v"] or 0.0) - (moments[f"{r}_m"] or 0.0) * (1 - (moments[f"{r}_m"] or 0.0)) * (moments["inv"] or 0.0)
        strength = max(1.0, mean * (1 - mean) / found - 1) if found > 0 and 0 < mean < 1 else PLAIN_STRENGTH
        shrunk.append(((F.col(r) + mean * strength) / (F.col("host_docs") + strength)).alias(f"rate_{r}"))
        limit = min(max_rate, max(min_rate, mean + spread * math.sqrt(mean * (1 - mean) / (strength + 1))))
        ok.append(F.col(f"rate_{r}") - F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (F.col("host_docs") + strength + 1)) <= F.lit(limit))
    return hosts.select("host", "host_docs", *shrunk).withColumn("host_ok", reduce(and_, ok))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """One row a document: its measures, ``base_failed``, ``doc_ok``, its host's rates and ``kept``; ``limits`` are
    those of host_verdicts."""
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m"))
    flat = materialize(m.select("doc_id", "host", "m.*"), "quality-measures")
    flags = flat.select("*", *[x.alias(r) for r, x in rules({c: F.col(c) for c in flat.columns}).items()])
    verdicts = materialize(host_verdicts(flags.select("host", *RULES), **limits), "quality-hosts")
    failed = F.col("short") | F.col("repeats")
    bad = failed | F.col("symbols") | F.col("lines") | F.col("shout")
    joined = flags.withColumn("h", F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))).join(verdicts.withColumn("h", F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))).drop("host"), "h")
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~bad).alias("doc_ok"), "host_docs", *[f"rate_{r}" for r in RULES], "host_ok", (~bad & F.col("host_ok")).alias("kept"))


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """``docs`` without the documents that ``judge`` rejects; every column stays as it is."""
    key = fresh_name(docs, "_row_key")
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    # rows of equal text and host share their verdict, so a hash of both is their key; wide rows are written nowhere
    keyed = docs.withColumn(key, F.concat_ws("/", F.coalesce(F.concat(F.lit("="), host), F.lit("")), F.xxhash64(text), F.coalesce(F.length(text), F.lit(-1))))
    m = materialize(keyed.select(F.col(f"`{key}`").alias("key"), host.alias("host"), measures(text).alias("m")).select("key", "host", *[x.alias(r) for r, x in rules(F.col("m")).items()]), "quality-rules")
    verdicts = materialize(host_verdicts(m.select("host", *RULES), **limits).filter("not host_ok").select(F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("bad_host")), "quality-hosts")
    own = reduce(or_, [F.col(r) for r in RULES])
    of_host = m.select("key", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("h")).join(verdicts, F.col("h") == F.col("bad_host"), "left_semi")
    gone = materialize(m.filter(own).select("key").unionByName(of_host.select("key")).distinct(), "quality-gone")
    return without_keys(keyed, key, gone, "key").drop(key)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
pos AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
grams AS (SELECT r, i, ws[i:i+4] AS g, count(*) OVER (PARTITION BY r, ws[i:i+4]) AS c FROM pos),
cover AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM grams WHERE c > 1) GROUP BY r),
m AS (
  SELECT t.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN w USING (r) LEFT JOIN cover USING (r)),
f AS (
  SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < 10 AS short,
    100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
    len(ls) - len(list_distinct(ls)) >= 2 AND (len(ls) - len(list_distinct(ls))) * 20 > n_words AS lines,
    2 * n_upper > word_chars AS shout
  FROM m),
counted AS (
  SELECT source, count(*) AS n, count_if(short) AS c1, count_if(repeats) AS c2, count_if(symbols) AS c3,
    count_if(lines) AS c4, count_if(shout) AS c5 FROM f GROUP BY source),
hosts AS (SELECT source, n, unnest([1, 2, 3, 4, 5]) AS rule, unnest([c1, c2, c3, c4, c5]) AS c FROM counted),
prior AS (
  SELECT rule, avg(c / n) AS mean, var_pop(c / n) - avg(c / n) * (1 - avg(c / n)) * avg(1 / n) AS spread FROM hosts GROUP BY rule),
strength AS (
  SELECT rule, mean, CASE WHEN spread > 0 AND mean > 0 AND mean < 1 THEN greatest(1, mean * (1 - mean) / spread - 1) ELSE 10 END AS k
  FROM prior),
shrunk AS (
  SELECT source, n, k, (c + mean * k) / (n + k) AS p, least(0.5, greatest(0.2, mean + 3 * sqrt(mean * (1 - mean) / (k + 1)))) AS top
  FROM hosts JOIN strength USING (rule)),
rated AS (SELECT source, bool_and(p - sqrt(p * (1 - p) / (n + k + 1)) <= top) AS host_ok FROM shrunk GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats OR symbols OR lines OR shout) AND host_ok AS kept
FROM f JOIN rated ON f.source IS NOT DISTINCT FROM rated.source
"""
