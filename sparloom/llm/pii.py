"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans, which may overlap: every match of the base patterns, valid or
not, and looser forms (numbers without a plus sign or with unusual separators, spelled-out addresses).
Each candidate has features of its format (digits, check digit, separators) and its context (words before
it, characters around it). Boosted trees of depth two are fitted for each kind; a threshold, calibrated on
the half of the labels that the trees did not see, selects what is added to the valid base spans, which
always stay.

Labels: valid base spans are positive; candidates that no form of their kind allows (a wrong check digit, too
few or too many digits, addresses out of range) are negative; the rest of the corpus has no label. What the
looser forms are is told by a labelled sample, EXAMPLES made texts of each label and kind from fixed formats
with and without context, which weighs as much as the corpus. Whether a span is a base span (its plus sign,
its pattern, its range test) is no feature.

Candidates are arrays inside the row; nothing is exploded or shuffled but the sample for the trees, at
most SAMPLE candidates of distinct texts, by a hash of the text. The trees are fitted on the driver to the
distinct feature vectors of that sample and applied as one column expression.

To keep Java's regular expressions from recursing over long runs, separators between two digits and dots
between two domain characters are first replaced, one code point by one, with the marks below; the marks
themselves, where a text holds them, are replaced by blanks for the search.

Defined results: a null text is empty; null and repeated ids are rows of their own; a corpus without
candidates leaves the labelled sample alone to fit to; an empty table gives an empty result; other columns are left
out. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import fresh_name, hashed_share, let, materialize

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the trees are fitted to and calibrated on, at most.
SAMPLE = 20_000
#: Made texts of each label and kind.
EXAMPLES = 400
TREES, DEPTH = 40, 2
RATE = 0.4
PRECISION = 0.98
JOIN, DOT = "\ue000", "\ue001"
LOCAL, DOMAIN = r"A-Za-z0-9._%+\-", r"A-Za-z0-9\-"
#: Words that make a kind likely when they stand just before it.
CONTEXT = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach)[^a-z]{0,12}$",
    "ip": r"(?i)(\bip|address|server|host|from|login)[^a-z]{0,12}$",
    "card": r"(?i)(card|visa|master|amex|credit|debit|payment|account)[^a-z]{0,12}$",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|whatsapp|contact)[^a-z]{0,12}$",
}
FEATURES = ("kind", "digits", "luhn", "separators", "parens", "dots", "shape", "context", "joined_before", "joined_after")
#: What a value, for cards its digits, looks like where nothing is written before it.
SHAPE = {
    "email": r"\.[A-Za-z]{2,}\.?$",
    "card": r"^(?:4[0-9]{12}(?:[0-9]{3})?|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11})$",
    "phone": r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20/])[0-9]{3}[-.\x20][0-9]{4}$",
}
NO_CONTEXT = 24


def running(lengths: Column) -> Column:
    """Sums of the elements before each one, in O(n * sqrt(n)) array steps."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def cut(a: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda g: F.slice(a, g * width + 1, width))
        return let(groups, lambda gs: let(F.transform(gs, add), lambda sums: F.flatten(F.transform(gs, lambda x, g: let(add(F.slice(sums, F.lit(1), g)), lambda base: F.transform(x, lambda _, j: base + add(F.slice(x, F.lit(1), j))))))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, cut))


def found(text: Column, pattern: str) -> Column:
    """Array of (value, start, before, after) of the matches, leftmost and non-overlapping."""

    def place(hits: Column, gaps: Column) -> Column:
        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        return let(running(steps), lambda at: F.transform(hits, lambda h, i: F.struct(h.alias("value"), (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"), F.right(F.get(gaps, i), F.lit(NO_CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(hits, lambda h: let(F.split(text, pattern, -1), lambda g: place(h, g)))).otherwise(F.array().cast("array<struct<value:string,start:int,before:string,after:string>>"))


PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BASE = {
    "email": rf"(?:(?<![{LOCAL}{DOT}])|\G)[{LOCAL}{DOT}]++@[{DOMAIN}]+{DOT}[{DOMAIN}{DOT}]+",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": rf"[0-9][0-9{JOIN}]*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"[{LOCAL}]{{1,64}}[ ]?[(\[](?:at|AT)[)\]][ ]?[{DOMAIN}.]{{1,64}}",
    "phone": r"(?<![0-9+.\-])\(?[0-9]{2,5}[)./\-\x20][\x20().0-9/-]{4,24}[0-9](?![0-9])",
}


def _candidate(kind: str, c: Column, loose: bool) -> Column:
    value = c["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if loose:
        base = F.lit(False)
    elif kind == "email":
        base = F.lit(True)
    elif kind == "ip":
        base = value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    elif kind == "card":
        base = n.between(16, 19) & F.call_function("luhn_check", digits)
    else:
        base = n.between(8, 15)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    features = {
        "kind": F.lit(KINDS.index(kind)),
        "digits": F.least(n, F.lit(24)),
        "luhn": flag(n.between(12, 24) & F.call_function("luhn_check", digits)),
        "separators": F.least(F.length(F.regexp_replace(value, rf"[^\x20{JOIN}/-]", "")), F.lit(8)),
        "parens": flag(F.contains(value, F.lit("("))),
        "dots": F.least(F.length(F.regexp_replace(value, rf"[^.{DOT}]", "")), F.lit(6)),
        "shape": flag((digits if kind == "card" else value).rlike(SHAPE[kind])) if kind in SHAPE else F.lit(0),
        "context": flag(c["before"].rlike(CONTEXT[kind])),
        "joined_before": flag(c["before"].rlike(r"[A-Za-z0-9]$")),
        "joined_after": flag(c["after"].rlike(r"[A-Za-z0-9]")),
    }
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), (c["start"] + F.length(value)).alias("end"), base.alias("base"), F.struct(*[x.alias(k) for k, x in features.items()]).alias("f"))


CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,f:struct<" + ",".join(f"{f}:int" for f in FEATURES) + ">>>"


def candidates(text: Column) -> Column:
    """All candidates of a text, kind by kind; single digits and short numbers are none."""
    text = F.translate(F.coalesce(text, F.lit("")), JOIN + DOT, "  ")
    dotted = F.regexp_replace(text, rf"(?<=[{DOMAIN}])\.(?=[{DOMAIN}])", DOT)
    joined = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)
    none = F.array().cast(CANDIDATE)
    made = lambda source, kind, patterns, loose=False: let(source, lambda t: F.transform(found(t, patterns[kind]), lambda c: _candidate(kind, c, loose))).cast(CANDIDATE)
    numbers = F.filter(made(joined, "card", BASE), lambda c: c["f"]["digits"] >= 12)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), made(dotted, "email", BASE)).otherwise(none),
        F.when(text.rlike(r"[(\[](?:at|AT)[)\]]"), made(text, "email", LOOSE, True)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), made(text, "ip", BASE)).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), numbers).otherwise(none),
        F.when(F.contains(text, F.lit("+")), made(text, "phone", BASE)).otherwise(none),
        F.when(text.rlike(r"[0-9][)./\-\x20][\x20().0-9/-]{4}"), made(text, "phone", LOOSE, True)).otherwise(none),
    )


# The trees: lists of (feature, threshold, left, right), leaves are numbers; left: feature <= threshold.


def _split(rows: list, grads: list, hess: list, members: list[int], depth: int):
    total_g, total_h = sum(grads[i] for i in members), sum(hess[i] for i in members)
    leaf = RATE * total_g / (total_h + 1.0)
    if not depth:
        return leaf
    best = (1e-6, None)
    for f in range(len(FEATURES)):
        sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for i in members:
            s = sums[rows[i][0][f]]
            s[0] += grads[i]
            s[1] += hess[i]
        g = h = 0.0
        for v in sorted(sums)[:-1]:
            g, h = g + sums[v][0], h + sums[v][1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, (f, v))
    if best[1] is None:
        return leaf
    f, v = best[1]
    parts = [[i for i in members if (rows[i][0][f] <= v) == side] for side in (True, False)]
    return (f, v, *[_split(rows, grads, hess, p, depth - 1) for p in parts])


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(rows: list[tuple[tuple[int, ...], int, int]]) -> list:
    """Boosted trees (logistic loss) from (features, positives, negatives)."""
    trees, scores = [], [0.0] * len(rows)
    for _ in range(TREES if rows else 0):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [pos * (1 - q) - neg * q for (_, pos, neg), q in zip(rows, p, strict=True)]
        hess = [(pos + neg) * q * (1 - q) for (_, pos, neg), q in zip(rows, p, strict=True)]
        trees.append(_split(rows, grads, hess, list(range(len(rows))), DEPTH))
        scores = [s + _value(trees[-1], x) for s, (x, _, _) in zip(scores, rows, strict=True)]
    return trees


def calibrate(trees: list, rows: list[tuple[tuple[int, ...], int, int]]) -> dict[int, float]:
    """The lowest score of each kind from which on all (smoothed) precision is PRECISION or more."""
    out = {}
    for kind in range(len(KINDS)):
        scored = sorted(((sum(_value(t, x) for t in trees), pos, neg) for x, pos, neg in rows if x[0] == kind), reverse=True)
        good = bad = 0
        for k, (s, pos, neg) in enumerate(scored):
            good, bad = good + pos, bad + neg
            if (k + 1 == len(scored) or scored[k + 1][0] != s) and good / (good + bad + 1) >= PRECISION:
                out[kind] = s
    return out


def _expression(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _expression(tree[2], f)).otherwise(_expression(tree[3], f))


def _formatted(rnd: random.Random, form: str) -> str:
    """The form with d for any digit, D for one above 1 and a for a letter."""
    return "".join(str(rnd.randrange(10)) if c == "d" else str(rnd.randrange(2, 10)) if c == "D" else rnd.choice("abcdefghiklmnoprstu") if c == "a" else c for c in form)


def _checked(rnd: random.Random, start: str, n: int, valid: bool = True) -> str:
    """A number of n digits whose check digit is right, or wrong."""
    body = start + "".join(str(rnd.randrange(10)) for _ in range(n - 1 - len(start)))
    total = sum(x - 9 * (x > 9) for i, c in enumerate(reversed(body)) for x in [int(c) * (2 - i % 2)])
    return body + str((-total + (0 if valid else rnd.randrange(1, 10))) % 10)


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int, int]]:
    """The labelled sample: (text, kind, label), a candidate or more of the kind in each text."""
    rnd = random.Random(seed)
    told = {"email": ("mail me: ", "email ", "contact ", "write to "), "card": ("card ", "visa: ", "credit card no. ", "payment by "), "phone": ("call ", "phone: ", "tel. ", "mobile ", "fax ")}
    plain = ("", "we saw ", "and then ", "the number ", "in ", "order ", "on ", "version ", "see ", "about ", "it was ")
    local = ("aaaaa.aaaaa", "aaaaa", "aaa_dd", "aaaa-aaa")
    at = (" (at) ", "(at)", " [at] ", " (AT) ", "[AT]")
    usual, abroad = ("(Ddd) Ddd-dddd", "(Ddd)Ddd-dddd", "Ddd-Ddd-dddd", "Ddd.Ddd.dddd", "Ddd Ddd dddd"), ("0dd dddd dddd", "0dddd dddddd", "0ddd/dddddd", "00dd dd dddd dddd", "(0dd) dddd dddd")
    dates = ("20dd-0D-1d", "0D.1d.20dd", "1d/0D/19dd", "19dd - 20dd", "20dd-20dd", "20dd/20dd")
    numbers = ("dd.ddd.ddd", "dddd dddd dddd", "97D-d-dd-dddddd-d", "DDD.DDD.DDD.DDD", "ddd-dd-dddd", "dd dd dd dd", "Ddd-dddd", "(dd) 20dd-0D-1d", "dd.d.dd.dddd")
    issuers = (("4", 13), ("34", 15), ("37", 15), ("30", 14), ("36", 14), ("38", 14))

    def email(good: bool) -> tuple[str, str]:
        name, end = _formatted(rnd, rnd.choice(local)), _formatted(rnd, rnd.choice(("aaaaaa", "aaaa-aaa")))
        host = f"{end}.{rnd.choice(('org', 'com', 'net', 'co.uk', 'de'))}"
        if good:
            return rnd.choice(((rnd.choice(plain + told["email"]), name + rnd.choice(at) + host), (rnd.choice(told["email"]), name + rnd.choice(at) + end)))
        return rnd.choice(plain), rnd.choice(("sold", "meet", "bought", "price")) + rnd.choice(at) + rnd.choice(("noon", "home", "work", "5", "12.50", "9.15"))

    def card(good: bool) -> tuple[str, str]:
        start, size = rnd.choice(issuers)
        start += str(rnd.randrange(6)) if start == "30" else ""
        if good:
            number = _checked(rnd, start, size)
            if size == 15 and rnd.random() < 0.5:
                number = f"{number[:4]} {number[4:10]} {number[10:]}"
            if rnd.random() < 0.3:
                return rnd.choice(told["card"]), _checked(rnd, rnd.choice("12679"), rnd.choice((13, 14, 15)))
            return rnd.choice(plain + told["card"]), number
        if rnd.random() < 0.5:
            return rnd.choice(plain + told["card"]), _checked(rnd, start, size, False)
        return rnd.choice(plain), _checked(rnd, rnd.choice(("1", "2", "7", "86", "35", "978")), rnd.choice((13, 14, 15)))

    def phone(good: bool) -> tuple[str, str]:
        if good:
            return rnd.choice(((rnd.choice(plain + told["phone"]), _formatted(rnd, rnd.choice(usual))), (rnd.choice(told["phone"]), _formatted(rnd, rnd.choice(abroad)))))
        return rnd.choice(((rnd.choice(plain), _formatted(rnd, rnd.choice(numbers))), (rnd.choice(plain + told["phone"]), _formatted(rnd, rnd.choice(dates)))))

    out = []
    for kind, made in (("email", email), ("card", card), ("phone", phone)):
        for k in range(2 * n):
            before, value = made(k % 2 == 0)
            out.append((before + value + rnd.choice((" ", ", ", "; ok", "\n", "")), KINDS.index(kind), int(k % 2 == 0)))
    return out


def _excluded(c: Column) -> Column:
    """Whether no form of its kind allows a candidate that is no base span."""
    n, luhn = c["f"]["digits"], c["f"]["luhn"]
    return F.when(c["kind"] == KINDS.index("card"), (luhn == 0) | ~n.between(13, 19)).when(c["kind"] == KINDS.index("phone"), ~n.between(7, 15)).otherwise(c["kind"] == KINDS.index("ip"))


def fit_model(found_in: DataFrame, column: str, h: str, sample: int = SAMPLE) -> dict[int, tuple[list, float]]:
    """Trees and threshold of each kind that has them, from the labelled sample and the candidate arrays of
    ``column`` of distinct texts (by their hash ``h``)."""
    total = found_in.agg(F.sum(F.size(column))).first()[0] or 0
    texts = found_in.filter(hashed_share(F.col(h), 0.9 * sample / max(1, total))).select(F.col(h).alias("h"), F.col(column).alias("c")).dropDuplicates(["h"])
    one = texts.select(F.explode("c").alias("c")).limit(sample)
    rows = one.groupBy("c.f", (F.xxhash64("c") % 2 == 0).alias("even")).agg(F.count_if("c.base").alias("pos"), F.count_if(~F.col("c.base") & _excluded(F.col("c"))).alias("neg")).filter("pos + neg > 0").collect()
    made = found_in.sparkSession.createDataFrame(examples(), "text string, kind int, label int")
    told = made.select("kind", "label", (F.xxhash64("text") % 2 == 0).alias("even"), F.explode(candidates(F.col("text"))).alias("c")).filter("c.kind = kind")
    told = told.groupBy("c.f", "even").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).collect()
    model = {}
    for kind in range(len(KINDS)):
        given, shown = ([r for r in part if r["f"]["kind"] == kind] for part in (rows, told))
        weight = max(1, sum(r["pos"] + r["neg"] for r in given) // max(1, sum(r["pos"] + r["neg"] for r in shown)))
        parts = {even: sorted([(tuple(r["f"]), r["pos"], r["neg"]) for r in given if r["even"] is even] + [(tuple(r["f"]), weight * r["pos"], weight * r["neg"]) for r in shown if r["even"] is even]) for even in (True, False)}
        trees = fit(parts[True])
        limits = calibrate(trees, parts[False])
        if trees and kind in limits:
            model[kind] = (trees, limits[kind])
    return model


def selected(column: Column, model: dict[int, tuple[list, float]]) -> Column:
    """The candidates that count: valid base ones, and others above their kind's threshold that overlap
    none of these; by kind and start."""
    base = F.filter(column, lambda c: c["base"])
    if model:
        score = lambda c, trees: sum((_expression(t, c["f"]) for t in trees), F.lit(0.0))
        enough = lambda c: F.coalesce(*[F.when(c["kind"] == k, score(c, trees) >= F.lit(limit)) for k, (trees, limit) in model.items()], F.lit(False))
        more = let(base, lambda b: F.filter(column, lambda c: ~c["base"] & enough(c) & ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))))
        base = F.concat(base, more)
    return F.sort_array(F.transform(base, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, found: array of (kind, start, end, base)) of every document."""
    own = materialize(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), candidates(F.col(text_col)).alias("c")), "pii-candidates")
    return own.select("doc_id", selected(F.col("c"), fit_model(own, "c", "h", sample)).alias("found"))


#: Code points of a block, of which ``redact`` cuts its pieces.
BLOCK = 1024


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span found replaced by its kind in angle brackets; overlapping spans are one, named by
    the first. ``length_col``: gets the length of the new text. Null texts stay null."""
    c, h = fresh_name(docs, "_candidates"), fresh_name(docs, "_hash")
    own = materialize(docs.withColumns({c: candidates(F.col(f"`{text_col}`")), h: F.xxhash64(f"`{text_col}`")}), "pii-docs")
    spans = selected(F.col(c), fit_model(own.select(c, h), c, h, sample))
    text = F.col(f"`{text_col}`")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(state: Column, x: Column) -> Column:
        # where the spans up to this one end furthest, before it; what starts before that lies inside them
        seen = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), state["far"].alias("was"))
        return F.struct(F.concat(state["done"], F.array(seen)).alias("done"), F.greatest(state["far"], x["end"]).alias("far"))

    def rewrite(s: Column) -> Column:
        # pieces of text are cut out of blocks, and spans are folded in runs, so that neither a long text nor one of
        # very many spans is gone through again for each span
        empty = lambda kind: F.array().cast(kind)
        one = "struct<start:int,kind:int,was:int>"
        size = F.ceil(F.sqrt(F.size(s))).cast("int")
        runs = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / n).cast("int")), lambda k: F.slice(s, k * n + 1, n)))
        folded = lambda state, run: let(F.aggregate(run, F.struct(empty(f"array<{one}>").alias("done"), state["far"].alias("far")), step), lambda r: F.struct(F.concat(state["done"], F.array(r["done"])).alias("done"), r["far"].alias("far")))
        ends = F.aggregate(runs, F.struct(empty(f"array<array<{one}>>").alias("done"), F.lit(0).alias("far")), folded)
        cut = lambda blocks, a, b: F.substring(F.array_join(F.slice(blocks, F.floor(a / BLOCK).cast("int") + 1, F.floor(b / BLOCK).cast("int") - F.floor(a / BLOCK).cast("int") + 1), ""), a % BLOCK + 1, b - a)
        pieces = lambda blocks, e: F.transform(F.flatten(e["done"]), lambda x: F.when(x["start"] < x["was"], F.lit("")).otherwise(F.concat(cut(blocks, x["was"], x["start"]), names[x["kind"]])))
        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: let(ends, lambda e: F.concat(F.array_join(pieces(blocks, e), ""), cut(blocks, e["far"], F.length(text)))))

    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    clean = let(by_start, lambda s: F.when(F.size(s) > 0, rewrite(s)).otherwise(text))
    out = own.withColumn(text_col, clean)
    if length_col:
        out = out.withColumn(length_col, F.when(F.col(f"`{length_col}`").isNotNull(), F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType)))
    return out.drop(c, h)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    spans = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["base"])

    def of_kind(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
