"""URL filters: rules by host and path, then a weighted URL vocabulary.

The vocabulary is an Aho-Corasick automaton over strict and soft terms. A hit counts if it is not part of
a longer run of letters or digits. A URL is blocked by one strict term, or by two distinct soft terms or more
whose weights reach ``soft_limit``; rules stand above the vocabulary.

The step is a map over URLs: no shuffle. The automaton is built once per Python worker from the terms,
which are a parameter, also from a table of a checked size (``vocabulary``).

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and is judged by
the vocabulary (null: allowed); repeated and null ids are rows of their own; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import ascii_lower

#: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# The vocabulary. One strict term rejects a URL.
STRICT = (
    "adult adultfriend bdsm blowjob brothel camgirl camgirls carding casino casinos cialis counterfeit cumshot darknet deepfake"
    " ddos escort escorts exploitkit fetish gambling hardcore hentai incest keylogger malware milf nsfw onlyfans phishing porn porno"
    " pornhub pornography pornstar ransomware redtube scam sexcam sexcams sexchat sexshop spyware swingers threesome viagra warez"
    " xhamster xnxx xvideos xxx youporn"
).split()
# Soft terms by weight. A URL needs two of them or more, of SOFT_LIMIT together.
SOFT_WORDS = {
    1: "bet bets bid bonus boost buy cash cheap claim click clickbait coupon coupons credit deal deals discount discounts download"
    " downloads earn extra free freebie gift gifts giveaway hack hacks hot instant limited loan loans lottery mega mod mods money"
    " offer offers outlet payday percent pill pills profit prize prizes promo quick rich sale sales save spin stream streaming unlimited"
    " unlock voucher watch win winner wins",
    2: "astrology babe babes bingo bitcoin clone cracked crack dating diet enlargement erotic exposed farm forex generator girls horoscope"
    " jackpot keygen kink lingerie miracle naked nude nudes nulled pharmacy poker pyramid replica replicas roulette serial seo sex sexy"
    " singles slot slots spam sportsbook spybot steroid steroids tabloid torrent torrents tramadol weightloss xanax",
}
SOFT = {term: weight for weight, terms in SOFT_WORDS.items() for term in terms.split()}
SOFT_LIMIT = 3
#: Terms that a vocabulary table may hold: its automaton goes with every task.
MAX_TERMS = 200_000


def vocabulary(terms: DataFrame) -> tuple[list[str], dict[str, int]]:
    """(strict terms, soft terms with weights) of a table (term, weight), for ``judge``; a null weight is strict.
    Terms are lower-cased and trimmed, blank ones left out; of a repeated term the strictest row counts. More
    than MAX_TERMS terms are an error."""
    rows = terms.select(F.btrim(ascii_lower(F.col("term"))).alias("t"), F.col("weight").cast("int").alias("w")).filter("t <> ''").groupBy("t").agg(F.max("w").alias("w"), F.count_if(F.col("w").isNull()).alias("strict")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary holds {MAX_TERMS} terms at most")
    return sorted(r["t"] for r in rows if r["strict"]), {r["t"]: r["w"] for r in rows if not r["strict"]}


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null. Rules are a parameter list; equal
    lengths go by the rule's text."""
    known = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    return F.coalesce(*[F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in known])


def _hits(batches: Iterator[pa.RecordBatch], strict: tuple[str, ...], soft: dict[str, int]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term in (*strict, *soft):
        automaton.add_word(term, term)
    automaton.make_automaton()
    is_strict, inside = set(strict), frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
    for batch in batches:
        n_strict, n_soft, weights = [], [], []
        for url in batch.column("low").to_pylist():
            found = set()
            for end, term in automaton.iter(url or ""):
                start = end - len(term)
                if (start < 0 or url[start] not in inside) and (end + 1 == len(url) or url[end + 1] not in inside):
                    found.add(term)
            hard = len(found & is_strict)
            n_strict.append(hard)
            n_soft.append(len(found) - hard)
            weights.append(sum(soft[t] for t in found if t not in is_strict))
        kept = [batch.column(c) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32()), pa.array(weights, pa.int32())], names=["page_id", "url", "n_strict", "n_soft", "soft_weight"])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=tuple(STRICT), soft=None, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(id, url, host, path, rule, verdict, n_strict, n_soft, soft_weight) of every URL."""
    soft = dict(SOFT if soft is None else soft)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    kind = own.schema["page_id"].dataType.simpleString()
    own = own.withColumn("low", ascii_lower(F.col("url")))
    hits = own.mapInArrow(lambda it: _hits(it, tuple(strict), soft), f"page_id {kind}, url string, n_strict int, n_soft int, soft_weight int")
    parts = hits.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parts.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    own_verdict = F.when((F.col("n_strict") > 0) | ((F.col("n_soft") >= 2) & (F.col("soft_weight") >= soft_limit)), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own_verdict).alias("verdict"), "n_strict", "n_soft", "soft_weight")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    hit = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)"
    fits = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p} {v}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    return f"""
WITH u AS (
  SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
{fits}
  END AS fit, {" + ".join(map(hit, STRICT))} AS hard,
  {" + ".join(f"{w} * {hit(t)}" for t, w in SOFT.items())} AS soft, {" + ".join(hit(t) for t in SOFT)} AS n_soft FROM u)
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) WHEN hard > 0 OR (n_soft >= 2 AND soft >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


OP7_SQL = _sql()
