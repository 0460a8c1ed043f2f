"""Alignment with the sequence ratio against a plain version, on the first parts."""

import difflib
import re

from pyspark.sql import functions as F

from sparloom import queries
from sparloom import vocabulary as V


def test_whole_score(spark, sf, tmp_path):
    part = spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").limit(60)
    part = part.withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")))
    part.write.parquet(str(tmp_path / "part.parquet"))
    rows = part.collect()
    words = lambda t: {V.ALIASES.get(x, x) for x in re.findall("[a-z0-9]+", t.lower()) if x not in V.STOPWORDS}
    want = set()
    for r in rows:
        scored = []
        types = sorted({x.p_type for x in rows if x.p_brand == r.p_brand})
        for k, t in enumerate(types):
            left, right = f"{r.p_name} {r.p_type}", f"{t} {t}"
            a, b = words(left), words(right)
            score = 0.65 * len(a & b) / len(a | b) + 0.25 * difflib.SequenceMatcher(None, left.lower(), right.lower()).ratio() + 0.15 * (r.p_type.lower() in t.lower())
            scored.append((-round(score, 4), k, t))
        for rank, (s, _, t) in enumerate(sorted(x for x in scored if x[0] <= -0.18)[:3]):
            want.add((r.p_partkey, t, rank + 1, -s))
    got = queries.QUERIES["align_candidates_sequences"](spark, str(tmp_path)).collect()
    assert {(r.finding, r.rule, r["rank"], r.mapping_score) for r in got} == want
    assert any(r.candidate_match_type == "exact_match_candidate" for r in got)
