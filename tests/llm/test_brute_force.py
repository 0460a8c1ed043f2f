"""Operators that SQL cannot express, against plain versions on the whole small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import low, words
from sparloom.llm import components, decontamination, html_text, lm_scoring, mixing, pii, simhash, substring_dedup


@pytest.mark.parametrize("pairs", [4_000_000, 1000])
def test_language_model(spark, sf, texts, pairs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PAIRS_PER_SHARD", pairs)
    got = {r.doc_id: r for r in lm_scoring.op1_lm_scoring(spark, sf).collect()}
    end = "\0end"
    tok = {i: [*words(t), end] for i, t in texts.items()}
    uni, bi = Counter(), Counter()
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            uni.update(w)
            bi.update(zip([end, *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)

    def disc(c):
        y = c[1] / (c[1] + 2 * c[2])
        return [0, 1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3]]

    d, cont, after = disc(Counter(bi.values())), Counter(b for _, b in bi), defaultdict(lambda: [0, 0, 0])
    for (a, _), c in bi.items():
        after[a][min(c, 3) - 1] += 1
    d1, m = disc(Counter(cont.values())), sum(cont.values())
    spare = sum(d1[min(c, 3)] for c in cont.values()) / m

    def one(w):
        c = cont.get(w, 0)
        return max(c - d1[min(c, 3)], 0) / m + spare / (v + 1)

    def two(a, w):
        if a not in uni:
            return one(w)
        c, k = bi.get((a, w), 0), after[a]
        return max(c - d[min(c, 3)], 0) / uni[a] + (d[1] * k[0] + d[2] * k[1] + d[3] * k[2]) / uni[a] * one(w)

    for i, w in tok.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.n_tokens == len(w) and r.train_tokens == n
        assert r.n_known == sum(x in uni for x in w)
        assert r.score == pytest.approx(sum(math.log10(two(a, x)) for a, x in zip([end, *w[:-1]], w, strict=True)), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((uni.get(x, 0) + 1) / (n + v + 1)) for x in w), rel=1e-9)
    assert sum(two("the", x) for x in uni) + two("the", "unknown!") == pytest.approx(1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x - 9 * (x > 9) for i, c in enumerate(reversed(digits)) for x in [int(c) * (1 + i % 2)]) % 10 == 0


def spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, sf, texts):
    import hashlib

    for r in pii.op2_pii(spark, sf).collect():
        want = spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k in BASE)


def test_personal_data_in_odd_texts(spark):
    rnd = random.Random(1)
    odd = ["a@b.c..d@e.f", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111", "1 " * 20_000, "a@" + "b." * 20_000 + "c", "a" * 50_000 + "@", "9" * 20_000, "+" + "1" * 20 + " +1234567", "ab@cd.-e@f.g", "😀 a@b.co"]
    odd += ["".join(rnd.choice("aA1 2.9-@+()_%\n4é") for _ in range(rnd.randrange(60))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    got = {r.doc_id: r.b for r in pii.find(d).select("doc_id", pii._joined(F.filter("found", lambda s: s["base"])).alias("b")).collect()}
    for i, t in enumerate(odd):
        assert got[i] == ",".join(spans(t)), t[:80]


def test_trees_learn_and_calibrate():
    rows = [((k, x, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), 30 * (x > 5), 30 * (x <= 5)) for k in range(4) for x in range(10)]
    trees = pii.fit(rows)
    value = lambda x: sum(pii._value(t, x) for t in trees)
    assert min(value(x) for x, p, _ in rows if p) > max(value(x) for x, p, _ in rows if not p)
    limits = pii.calibrate(trees, rows)
    assert all((value(x) >= limits[x[0]]) == (p > 0) for x, p, _ in rows)


def test_repeated_passages(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 5000)
    extra = spark.createDataFrame([(10_001, "x " * 100), (10_002, "y " + "x " * 80), (10_003, "a b " * 60), (10_004, "q a b " + "b a " * 40), (10_005, None), (10_006, "z " * 49), (10_007, "z " * 49)], "doc_id long, text string")
    d = documents.select("doc_id", "text").union(extra)
    all_texts = texts | {r.doc_id: r.text for r in extra.collect()}
    for size in (50, 12):
        seen, want = defaultdict(set), set()
        for i, t in all_texts.items():
            w = words(t)
            for k in range(len(w) - size + 1):
                seen[tuple(w[k : k + size])].add(i)
        for i, t in all_texts.items():
            w, now = words(t), None
            for k in range(len(w) - size + 1):
                if len(seen[tuple(w[k : k + size])]) > 1:
                    if now and k <= now[1]:
                        now[1] = k + size
                    else:
                        want |= {(i, *now)} if now else set()
                        now = [k, k + size]
            want |= {(i, *now)} if now else set()
        assert {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.passages(d, min_words=size).collect()} == want


def tiles(doc, item, least):
    """Greedy string tiling by scanning all places."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and i + k not in used_i and d + k not in used_d:
                    k += 1
                if k > best[0] or (k == best[0] and k and (i, d) < best[1:]):
                    best = (k, i, d)
        n, i, d = best
        if n < least:
            return out
        out.append((d, i, n))
        used_d |= set(range(d, d + n))
        used_i |= set(range(i, i + n))


def test_greedy_tiling():
    rnd = random.Random(5)
    for _ in range(200):
        item = [rnd.choice("abc") for _ in range(rnd.randrange(3, 16))]
        doc = [rnd.choice("abc") for _ in range(rnd.randrange(3, 25))]
        least = rnd.randrange(2, 4)
        seeds = [(d, i) for d in range(len(doc) - least + 1) for i in range(len(item) - least + 1) if doc[d : d + least] == item[i : i + least]]
        assert decontamination.tile(seeds, least) == tiles(doc, item, least)


def test_contamination(spark, documents, texts, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", low(t))
    items = {r.item_id: clean(r.text) for r in b.collect()}
    reordered = " ".join([*items[0][12:], "in between", *items[0][:12]])
    d = documents.select("doc_id", "text").union(spark.createDataFrame([(9001, reordered), (9002, " ".join(items[1][::2]))], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.covered for r in decontamination.contaminated(d, b).collect()}
    want = {}
    for i, t in (texts | {9001: reordered, 9002: " ".join(items[1][::2])}).items():
        w = clean(t)
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for j, item in items.items():
            if any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                seeds = [(x, y) for x in range(len(w) - 4) for y in range(len(item) - 4) if w[x : x + 5] == item[y : y + 5]]
                total = sum(n for _, _, n in decontamination.tile(seeds, 5))
                if total >= 0.5 * len(item):
                    want[i, j] = total
    assert got == want and (9001, 0) in got and (9002, 1) not in got


def fingerprint(text):
    w = words(text)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    bits = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(sh))


def smallest(n, linked):
    up = list(range(n))
    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            x, y = a, b
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
    out = []
    for a in range(n):
        while up[a] != a:
            a = up[a]
        out.append(a)
    return out


def test_fingerprints_and_components(spark, sf, texts):
    rows = sorted((i, fingerprint(t)) for i, t in texts.items())
    roots = smallest(len(rows), lambda a, b: (rows[a][1] ^ rows[b][1]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", rows[roots[k]][0]) for k, (i, f) in enumerate(rows)}


def test_links_in_crowded_buckets(spark):
    """Clusters of fingerprints a few bits apart: every link that joins components must be found."""
    rnd = random.Random(7)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            f = centre
            for b in rnd.sample(range(64), rnd.randrange(5)):
                f ^= 1 << b
            fps.add(f - (1 << 64) if f >> 63 else f)
    fps = sorted(fps)
    roots = smallest(len(fps), lambda a, b: ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3)
    got = {r.a: r.b for r in simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert [got.get(f, f) for f in fps] == [fps[r] for r in roots]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(1000, k) for k in range(1001, 1100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def test_minimum_cut():
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.randrange(1, 8)
        s, k = [rnd.randrange(8) for _ in range(n)], [rnd.randrange(8) for _ in range(n)]
        e = {(a, b): rnd.randrange(1, 6) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5}
        cost = lambda l: sum(k[i] if l[i] else s[i] for i in range(n)) + sum(c for (a, b), c in e.items() if l[a] != l[b])  # noqa: B023, E731, E741
        assert cost(html_text.max_flow_cut(s, k, e)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_main_text(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op9_html_extraction(spark, sf).collect():
        article = re.sub("<br>", " ", re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_main_text_without_article():
    page = """<html><body><div class="menu"><a href=x>Home</a> <a href=y>News</a></div><div><div><h1>Title here</h1><p>First para with words, and
    more words. It goes on for a while, as text does.</p><p>Second &amp; third para. It also goes on.</p></div><div class="cookie-notice">We use cookies.</div>
    <form>Name <input></form><div id="comments"><p>Great post, I liked it a lot. Thanks for writing.</p></div></div><div class="footer">Copyright</div><script>var x="<p>no</p>" """
    got = html_text.extract(page, html_text.weights({})).split("\n\n")
    assert got[-2:] == ["First para with words, and more words. It goes on for a while, as text does.", "Second & third para. It also goes on."]
    for bad in ("", "<", "<p", "<!-- x", '<a "' * 20_000, "<p>" * 20_000, "<div>" * 5000 + "x"):
        html_text.extract(bad, {})


def test_mix_comes_near_targets(spark, sf):
    rows = mixing.op10_mixing(spark, sf).collect()
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r.size
        by[sources[r.doc_id]].append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group) + 1
    assert sum(g[0].target for g in by.values()) == pytest.approx(sum(r.size for r in rows))
    again = {r.doc_id: r.taken for r in mixing.op10_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
