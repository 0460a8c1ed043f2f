"""Spelling variants against a plain version, also where buckets are cut again and again."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm_helpers import low
from sparloom.llm import spelling


def plain_counts(texts, min_chars=7, min_count=2, every=31):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def plain_forms(n, times=10):
    out = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            out[i, len(w), w[:i] + w[i + 1 :]].append(w)
    near = defaultdict(set)
    for (_, _, rest), ws in out.items():
        for w in ws:
            near[w].update(x for x in ws if x != w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(near[w], key=lambda x: (-n[x], x.encode())) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= times * n[w]}
    root = {}
    for w in n:
        r = w
        while r in form:
            r = form[r]
        root[w] = r
    return {(w, k, len(near[w]), form.get(w), n[form[w]] if w in form else None, root[w]) for w, k in n.items()}


def test_query(spark, sf, documents, texts):
    got = {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.op12_spelling_variants(spark, sf).collect()}
    want = plain_forms(plain_counts(texts.items()))
    assert got == want and any(x[3] for x in want)


@pytest.mark.parametrize("crowded", [2_000, 0])
def test_pairs(spark, crowded):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))) for _ in range(600)} | {"aaaaaaaa" + x for x in "abcdefgh"} | {"x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 20}
    n = dict.fromkeys(words, 1) | {"xxxxxxx": 5}
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), crowded).collect()
    near = lambda a, b: a != b and ((len(a) == len(b) and sum(p != q for p, q in zip(a, b, strict=True)) == 1) or (len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))))
    want = {(a, b) for a in n for b in n if near(a, b) and (len(a) < len(b) or a < b)}
    assert len(got) == len(want) and {(r.x, r.y) for r in got} == want


def test_roots_follow_forms(spark):
    n = {"letters": 10_000, "lettersa": 900, "letterab": 80, "lettexab": 7, "another": 5, "anothes": 5}
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {"letters": (None, "letters", 1), "lettersa": ("letters", "letters", 1), "letterab": (None, "letterab", 1), "lettexab": ("letterab", "letterab", 1), "another": (None, "another", 1), "anothes": (None, "anothes", 1)}


def test_ties_go_to_the_smallest(spark):
    n = {"worders": 1, "wörders": 50, "zorders": 50, "vorders": 50}
    got = {r.word: r.form for r in spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["worders"] == "vorders"


def test_blocks(monkeypatch):
    text = "Alpha beta, GAMMAdelta\n" * 50 + "x" * 40
    whole = spelling._runs(text, 4)
    monkeypatch.setattr(spelling, "BLOCK", 10)
    assert spelling._runs(text, 4) == whole == {"alpha": 50, "beta": 50, "gammadelta": 50, "x" * 40: 1}


def test_odd_rows(spark, odd, none):
    got = {r.word: r.n for r in spelling.word_counts(odd, min_chars=4, every=3).collect()}
    assert got == plain_counts([(r.doc_id, r.text) for r in odd.collect()], 4, 2, 3)
    whole = spelling.spelling_variants(odd, min_chars=4)
    assert {r.word: r.n for r in whole.collect()}["alpha"] == 3 and whole.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert spelling.spelling_variants(none).count() == 0


def test_long_words(spark):
    long = "ab" * 100_000
    made = [long, long + "a", "é" + long[1:], long[:777] + "é" + long[777:], long[:-1] + "é", long[:500] + long[502:], "c" * 300, "c" * 301, "c" * 302, "c" * 299 + "d"]
    text = " ".join(made * 2)
    got = {r.word: r.n_near for r in spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert [got[w] for w in made] == [4, 1, 1, 1, 1, 0, 2, 2, 1, 1]
