"""Queries of the matching side over the driver tables: coverage audit, extraction, metrics of assignments, templates,
corrections, the dataset audit; with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.similarity import cosine
from sparloom.functions.text import char_similarity
from sparloom.operators import alignment, assignment, audit, basics, coverage, templates, updates
from sparloom.plans import extraction
from sparloom.queries import query, table

NAMES = ("红色外套", "黑色短靴", "金属腰带", "蓝色眼睛", "白色手套", "帽子", "深蓝长裤", "花纹", "银色项链", "毛边外套", "短裙", "长裙")
DETAILS = ("", "毛边", "红色", "皮革 黑色", "绑腿", "长款")
PARTS = ("红色外套与黑色短靴", "帽子与手套", "花纹与白色手套")


def _elements(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines of an order as gold elements (odd numbers) and predicted ones (even numbers), one of each number."""
    line = basics.keep_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])
    word = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    blank = [F.lit("").alias(c) for c in ("category", "color", "material", "shape", "location")]
    base = [F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_linenumber").alias("index")]
    gold = line.filter("l_linenumber % 2 = 1").select(*base, word(NAMES, F.col("l_partkey")).alias("name"), F.lit("").alias("value"), *blank)
    pred = line.filter("l_linenumber % 2 = 0").select(*base, word(NAMES, F.col("l_suppkey")).alias("name"), word(DETAILS, F.col("l_partkey")).alias("value"), *blank)
    return gold, pred


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _families_sql(text: str, families) -> str:
    """Sorted names of families with a keyword in the text."""
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains({text}, '{k}')''' for k in ks)} THEN '{f}' END" for f, ks in sorted(families.items())) + "], lambda f: f IS NOT NULL)"


def _chars_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split({text}, ''), lambda c: c <> '' AND c <> ' '))"


def _overlap_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN greatest(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), len(list_intersect({a}, {b})) / least(len({a}), len({b}))) ELSE 0 END)"


_FIRST = "len(list_intersect(g.named, p.prim))"
_SECOND = "len(list_intersect(g.named, p.sec))"
_SCORE = f"""greatest({_overlap_sql("g.chars", "p.chars")}, CASE WHEN len(list_intersect(g.chars, p.name_chars)) >= 2 THEN {_overlap_sql("g.chars", "p.name_chars")} ELSE 0 END,
  CASE WHEN {_FIRST} > 0 THEN least(9e-1, 62e-2 + 8e-2 * {_FIRST}) WHEN {_SECOND} > 0 THEN least(72e-2, 5e-1 + 6e-2 * {_SECOND}) ELSE 0 END)"""
ELEMENTS = f"""
one AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
g0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_linenumber AS i, {_list(NAMES)}[l_partkey % {len(NAMES)} + 1] AS name FROM one WHERE l_linenumber % 2 = 1),
g AS (SELECT *, {_chars_sql("name")} AS chars, {_families_sql("name", V.OBJECT_FAMILIES)} AS named FROM g0),
p0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_linenumber AS i, {_list(NAMES)}[l_suppkey % {len(NAMES)} + 1] AS name, {_list(DETAILS)}[l_partkey % {len(DETAILS)} + 1] AS value FROM one WHERE l_linenumber % 2 = 0),
p1 AS (SELECT *, name || ' ' || value AS text, {_chars_sql("name || value")} AS chars, {_chars_sql("name")} AS name_chars, {_families_sql("name", V.OBJECT_FAMILIES)} AS named, {_families_sql("name || ' ' || value", V.OBJECT_FAMILIES)} AS whole FROM p0),
p AS (SELECT *, list_distinct(list_concat(named, list_intersect(whole, {_list(V.DETAIL_OBJECTS)}))) AS prim, list_filter(whole, lambda x: NOT list_contains(named, x) AND x NOT IN ('fur_trim', 'leg_wraps')) AS sec FROM p1)
"""
AUDIT = f"""{ELEMENTS},
pairs AS (SELECT g.sample_id, g.i AS gi, p.i AS pi, g.named, p.prim, {_SCORE} AS s, {_FIRST} AS f1, {_SECOND} AS f2, list_intersect(g.named, list_concat(p.prim, p.sec)) AS shared FROM g JOIN p USING (sample_id)),
near AS (SELECT * FROM pairs WHERE s >= 32e-2 OR f1 + f2 > 0),
top AS (SELECT sample_id, gi, s, pi FROM near QUALIFY row_number() OVER (PARTITION BY sample_id, gi ORDER BY f1 > 0 DESC, f1 DESC, f2 DESC, s DESC, pi) = 1),
objects AS (SELECT sample_id, gi, pi, s, prim, named, unnest(shared) AS o FROM near),
chosen AS (SELECT sample_id, gi, o, pi FROM objects QUALIFY row_number() OVER (PARTITION BY sample_id, gi, o ORDER BY list_contains(prim, o) DESC, s DESC, pi) = 1),
got AS (SELECT sample_id, gi, list(o) AS objects, list(DISTINCT pi) AS items FROM chosen GROUP BY ALL),
audits AS (SELECT g.sample_id, g.i AS gold_index, g.name AS gold_name, CASE WHEN got.gi IS NOT NULL THEN len(list_filter(g.named, lambda x: NOT list_contains(got.objects, x))) = 0 ELSE coalesce(top.s >= 32e-2, false) END AS covered,
  CASE WHEN got.gi IS NOT NULL THEN got.items WHEN top.s >= 32e-2 THEN [top.pi] ELSE [] END AS covering, round(coalesce(top.s, 0), 3) AS best_score,
  CASE WHEN got.gi IS NOT NULL THEN list_filter(g.named, lambda x: NOT list_contains(got.objects, x)) WHEN top.s >= 32e-2 THEN [] ELSE g.named END AS missing
  FROM g LEFT JOIN top ON top.sample_id = g.sample_id AND top.gi = g.i LEFT JOIN got ON got.sample_id = g.sample_id AND got.gi = g.i)
"""


_COLOR_WORDS = ", ".join(f"{{'w': '{w.lower()}', 'f': '{f}'}}" for w, f in sorted(((w, f) for f, ws in V.COLOR_ALIASES.items() for w in ws), key=lambda x: -len(x[0])))


def _look_sql(text: str) -> str:
    """Families and shades of a text. Shades: the longest words claim their first free place, one after another."""
    plain = f"regexp_replace({text}, '{V.ACCESSORY_MATERIAL}', '', 'g')"
    claim = "CASE WHEN contains(s.w, x.w) THEN {'w': left(s.w, instr(s.w, x.w) - 1) || repeat(chr(1), length(x.w)) || substr(s.w, instr(s.w, x.w) + length(x.w)), 'f': s.f || ',' || x.f} ELSE s END"
    shades = f"list_reduce(list_concat([{{'w': lower({text}), 'f': ''}}], [{_COLOR_WORDS}]), lambda s, x: {claim}).f"
    sets = ((V.COLOR_FAMILIES, "colors"), (V.MATERIAL_FAMILIES, "materials"), (V.SHAPE_FAMILIES, "shapes"))
    return ", ".join([*(f"{_families_sql(plain, f)} AS {n}" for f, n in sets), f"list_sort(list_distinct(list_filter(string_split({shades}, ','), lambda x: x <> ''))) AS shades"])


def _one_group_sql(shades: str) -> str:
    return f"(len({shades}) >= 2 AND (" + " OR ".join(f"len(list_filter({shades}, lambda y: NOT list_contains({_list(group)}, y))) = 0" for group in V.TOLERATED_COLORS) + "))"


def _apart_sql(c: str) -> str:
    return f"(len(a.{c}) > 0 AND len(b.{c}) > 0 AND len(list_intersect(a.{c}, b.{c})) = 0)"


_ALL_SHADES = "list_sort(list_distinct(list_concat(a.shades, b.shades)))"
_SINGLES = f"list_filter(a.shades, lambda s: {_one_group_sql('list_distinct(list_concat(b.shades, [s]))')})"
_OPPOSITE = "(" + " OR ".join(f"(list_contains(a.shapes, '{x}') AND list_contains(b.shapes, '{y}')) OR (list_contains(a.shapes, '{y}') AND list_contains(b.shapes, '{x}'))" for x, y in V.SHAPE_OPPOSITES) + ")"


def _note_sql(kind: str, c: str) -> str:
    quote = "chr(39)"
    shown = lambda side: f"'[' || {quote} || array_to_string({side}.{c}, {quote} || ', ' || {quote}) || {quote} || ']'"
    return f"'{kind} conflict: gold=' || {shown('a')} || ', pred=' || {shown('b')}"


#: Two looks, a of the gold text and b of the predicted one: conflicts between them, and shades that are tolerated.
_BETWEEN = f"""
list_filter([CASE WHEN differ AND NOT ok THEN {_note_sql("color", "colors")} END, CASE WHEN {_apart_sql("materials")} THEN {_note_sql("material", "materials")} END, CASE WHEN {_OPPOSITE} THEN {_note_sql("shape", "shapes")} END], lambda n: n IS NOT NULL) AS notes,
CASE WHEN differ AND ok THEN CASE WHEN len(singles) > 0 THEN list_sort(list_distinct(list_concat(b.shades, singles))) ELSE all_shades END END AS tolerated"""
_SETTLED = f"{_apart_sql('colors')} AS differ, {_ALL_SHADES} AS all_shades, {_SINGLES} AS singles"
# A pair of texts is looked at once, however many elements have it.
NOTED = f"""{AUDIT},
look AS (SELECT text, {_look_sql("text")} FROM (SELECT name AS text FROM g UNION SELECT text FROM p)),
kept AS (
  SELECT DISTINCT sample_id, gi, pi, s FROM chosen JOIN (SELECT sample_id, gi, pi, s FROM near) n USING (sample_id, gi, pi)
  UNION ALL SELECT sample_id, gi, pi, s FROM top WHERE s >= 32e-2 AND NOT EXISTS (FROM got WHERE got.sample_id = top.sample_id AND got.gi = top.gi)),
told AS (SELECT k.*, g.name AS gt, p.text AS pt FROM kept k JOIN g ON g.sample_id = k.sample_id AND g.i = k.gi JOIN p ON p.sample_id = k.sample_id AND p.i = k.pi),
settled AS (SELECT gt, pt, a, b, {_SETTLED} FROM (SELECT DISTINCT gt, pt FROM told) JOIN look a ON a.text = gt JOIN look b ON b.text = pt),
between_texts AS (SELECT gt, pt, {_BETWEEN} FROM (SELECT *, {_one_group_sql("all_shades")} OR len(singles) > 0 AS ok FROM settled)),
noted AS (
  SELECT sample_id, gi AS gold_index, array_to_string(flatten(list(notes ORDER BY s DESC, pi)), '; ') AS conflict_notes,
    coalesce(array_to_string(list(array_to_string(tolerated, '+') ORDER BY s DESC, pi) FILTER (tolerated IS NOT NULL), '; '), '') AS tolerated
  FROM told JOIN between_texts USING (gt, pt) GROUP BY ALL),
full_audits AS (SELECT audits.*, coalesce(conflict_notes, '') AS conflict_notes, coalesce(tolerated, '') AS tolerated FROM audits LEFT JOIN noted USING (sample_id, gold_index))
"""


@query(f"WITH {NOTED} SELECT sample_id, gold_index, gold_name, covered, array_to_string(list_sort(covering), ',') AS covering, best_score, array_to_string(list_sort(missing), ',') AS missing, conflict_notes, tolerated FROM full_audits")
def coverage_audit(spark, sf_dir):
    """Gold elements by the predictions that cover them: objects of their names first, else the score; with what is at
    odds between them and the shades that are tolerated."""
    found = coverage.audit_gold(*_elements(spark, sf_dir))
    shown = [F.array_join("missing", ",").alias("missing"), F.array_join("conflict_notes", "; ").alias("conflict_notes"), F.array_join(F.transform("tolerated", lambda x: F.array_join(x, "+")), "; ").alias("tolerated")]
    return found.select("sample_id", "gold_index", "gold_name", "covered", F.array_join(F.array_sort(F.transform("covering", lambda i: i)), ",").alias("covering"), "best_score", *shown)


_EXTRAS = f"""{AUDIT},
used AS (SELECT DISTINCT sample_id, unnest(covering) AS i FROM audits),
left_over AS (SELECT p.* FROM p LEFT JOIN used USING (sample_id, i) WHERE used.i IS NULL),
scored AS (SELECT p.sample_id, p.i AS pi, p.name, g.i AS gi, CASE WHEN g.i IS NULL THEN 0 ELSE {_SCORE} END AS s, coalesce(len(list_intersect(g.named, p.prim)) > 0, false) AS shared FROM left_over p LEFT JOIN g USING (sample_id)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY sample_id, pi ORDER BY s DESC, gi) = 1),
extra AS (SELECT sample_id, pi AS pred_index, name AS pred_name, CASE WHEN s >= 32e-2 AND shared THEN 'supported_extra' WHEN s >= 32e-2 THEN 'unsupported_extra' ELSE 'needs_review' END AS classification, CASE WHEN s > 0 THEN gi END AS best_gold_index, round(s, 3) AS best_score FROM best)
"""


@query(f"WITH {_EXTRAS} SELECT * FROM extra")
def coverage_extras(spark, sf_dir):
    """Predictions that cover nothing: supported, unsupported or for review."""
    return coverage.audit_all(*_elements(spark, sf_dir))[1]


@query(f"WITH {_EXTRAS.replace(AUDIT, NOTED)}, a AS (SELECT count(*) AS gold_count, CAST(count_if(covered) AS BIGINT) AS covered_gold_count, CAST(count_if(conflict_notes <> '') AS BIGINT) AS conflict_count, CAST(count_if(tolerated <> '') AS BIGINT) AS color_family_tolerated_count FROM full_audits), e AS (SELECT CAST(count_if(classification = 'supported_extra') AS BIGINT) AS supported_extra_count, CAST(count_if(classification = 'unsupported_extra') AS BIGINT) AS unsupported_extra_count, CAST(count_if(classification = 'needs_review') AS BIGINT) AS needs_review_count FROM extra) SELECT *, covered_gold_count / gold_count AS gold_coverage_rate, covered_gold_count / 100000 AS all_gold_coverage_rate FROM a, e")
def coverage_totals(spark, sf_dir):
    """Counts of gold covered, at odds and tolerated, and of extras, with the rates over the gold evaluated and over all
    gold."""
    return coverage.totals(*coverage.audit_all(*_elements(spark, sf_dir)), 100_000)


@query(f"""
WITH {ELEMENTS},
w AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_linenumber AS gold_index, {_list(PARTS)}[l_partkey % 3 + 1] AS gold_name FROM one WHERE l_linenumber % 2 = 1),
parts AS (SELECT sample_id, gold_index, gold_name, unnest(range(1, 3)) AS k, unnest(string_split(gold_name, '与')) AS name FROM w),
q AS (SELECT *, {_chars_sql("name")} AS chars, {_families_sql("name", V.OBJECT_FAMILIES)} AS named FROM parts),
scored AS (SELECT g.sample_id, g.gold_index, g.gold_name, g.k, coalesce(max({_SCORE}), 0) AS s FROM q g LEFT JOIN p ON p.sample_id = g.sample_id GROUP BY ALL)
SELECT sample_id, gold_index, gold_name, bool_and(s >= 32e-2) AS covered, round(max(s), 3) AS best_score FROM scored GROUP BY ALL
""")
def composite_coverage(spark, sf_dir):
    """Gold names of two parts: each must be near some prediction."""
    gold, pred = _elements(spark, sf_dir)
    line = basics.keep_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])
    name = F.element_at(F.array(*map(F.lit, PARTS)), (F.col("l_partkey") % 3 + 1).cast("int"))
    whole = gold.drop("name").join(line.select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_linenumber").alias("index"), name.alias("name")), ["sample_id", "index"])
    return coverage.audit_gold(whole, pred).select("sample_id", "gold_index", "gold_name", "covered", "best_score")


# Pairs of colours, materials and shapes that may be at odds.
LEFT = ("红色长裤", "黑色布裤", "蓝色皮革", "白色", "窄款金属", "圆形", "红色金属搭扣")
RIGHT = ("粉色短裤", "棕色皮革", "青色", "银白色", "宽松布", "尖", "绿色")
@query(f"""
WITH t AS (SELECT {_list(LEFT)}[l_partkey % 7 + 1] AS gt, {_list(RIGHT)}[l_suppkey % 7 + 1] AS pt, count(*) AS n FROM lineitem GROUP BY ALL),
look AS (SELECT text, {_look_sql("text")} FROM (SELECT gt AS text FROM t UNION SELECT pt FROM t)),
settled AS (SELECT gt, pt, n, a, b, {_SETTLED} FROM t JOIN look a ON a.text = gt JOIN look b ON b.text = pt),
c AS (SELECT *, {_BETWEEN} FROM (SELECT *, {_one_group_sql("all_shades")} OR len(singles) > 0 AS ok FROM settled))
SELECT gt AS a, pt AS b, array_to_string(notes, '; ') AS notes, coalesce(array_to_string(tolerated, '+'), '') AS tolerated, n FROM c
""")
def element_conflicts(spark, sf_dir):
    """Pairs of texts by the conflicts between them; colours that differ are a conflict or tolerated."""
    word = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.col(k) % 7 + 1).cast("int"))
    line = table(spark, sf_dir, "lineitem").select(word(LEFT, "l_partkey").alias("a"), word(RIGHT, "l_suppkey").alias("b"))
    blank = [F.lit("").alias(c) for c in ("value", "category", "color", "material", "shape", "location")]
    kinds = line.groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = [coverage.prepared(kinds.select(F.concat_ws("/", "a", "b").alias("sample_id"), F.lit(0).alias("index"), F.col(c).alias("name"), *blank), side) for c, side in (("a", "gold"), ("b", "pred"))]
    c = kinds.withColumn("sample_id", F.concat_ws("/", "a", "b")).join(sides[0], "sample_id").join(sides[1], "sample_id").withColumn("c", coverage.conflicts())
    return c.select("a", "b", F.array_join("c.notes", "; ").alias("notes"), F.coalesce(F.array_join("c.tolerated", "+"), F.lit("")).alias("tolerated"), "n")


# Answers of a model: lines of an order as a list under one of three names, else as features.
ROOTS = ("elements", "extracted_elements", "atomic_rules")


def _answers(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit(" part "), F.col("l_partkey").cast("string")))
    value = F.when(F.col("l_quantity") > 25, "").otherwise(F.concat(F.lit("value of "), F.col("l_partkey").cast("string"), F.lit(" and so on and on")))
    item = F.struct(name.alias("name"), value.alias("description"), F.when(F.col("l_tax") > 0.04, "Skin-Body").otherwise("Cape").alias("category"), F.struct(F.lit("red ").alias("color")).alias("attributes"), F.when(F.col("l_discount") > 0.05, "0.95").otherwise("low").alias("confidence"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice", "l_shipdate")
    d = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("i"))))["i"].alias("items"))
    body = F.to_json("items")
    root = F.element_at(F.array(*map(F.lit, ROOTS)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit('{"'), root, F.lit('": '), body, F.lit("}"))
    return d.select(F.col("l_orderkey").cast("string").alias("sample_id"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), text)).alias("answer"))


ANSWERS = """
a AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount, l_extendedprice, l_shipdate) AS k,
  CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'part ' || l_partkey END AS n, CASE WHEN l_quantity > 25 THEN '' ELSE 'value of ' || l_partkey || ' and so on and on' END AS x, CASE WHEN l_tax > 0.04 THEN 'skin_body' ELSE 'other' END AS category, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS confidence FROM lineitem),
e AS (SELECT sample_id, sample_id || '_e' || lpad(CAST(k AS VARCHAR), 3, '0') AS element_id, CASE WHEN n <> '' THEN n ELSE substr(x, 1, 20) END AS name, CASE WHEN x <> '' THEN x ELSE n END AS value, category, 'red' AS color, '' AS material, '' AS shape, '' AS location, confidence FROM a WHERE n <> '' OR x <> '')
"""


@query(f"WITH {ANSWERS} SELECT * FROM e")
def extracted_elements(spark, sf_dir):
    """Elements out of fenced or introduced JSON, under any of three names; items that say nothing keep their number."""
    return extraction.elements(_answers(spark, sf_dir))


@query(f"WITH {ANSWERS} SELECT sample_id, element_id AS rule_id, value FROM e")
def elements_as_rules(spark, sf_dir):
    """The same as rules."""
    return extraction.as_rules(extraction.elements(_answers(spark, sf_dir)))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CAST(c_custkey AS VARCHAR) || '_e' || lpad(CAST(k AS VARCHAR), 3, '0') AS element_id, name, value FROM (
  SELECT c_custkey, unnest([1, 2, 3]) AS k, unnest(['hair', 'outfit', 'extras']) AS name, unnest([c_name, 'coat: ' || c_mktsegment || '；shoes: boots', 'bag；' || c_nationkey]) AS value FROM customer)
""")
def identity_features(spark, sf_dir):
    """Elements out of identity features, nested values as text, where an answer has no list."""
    c = table(spark, sf_dir, "customer")
    text = F.to_json(F.struct(F.struct(F.col("c_name").alias("hair"), F.struct(F.col("c_mktsegment").alias("coat"), F.lit("").alias("none"), F.lit("boots").alias("shoes")).alias("outfit"), F.array(F.lit("bag"), F.lit(""), F.col("c_nationkey").cast("string")).alias("extras")).alias("identity_features")))
    found = extraction.elements(c.select(F.col("c_custkey").cast("string").alias("sample_id"), text.alias("answer")))
    keys = F.element_at(F.create_map(F.lit("hair"), F.lit(1), F.lit("outfit"), F.lit(2), F.lit("extras"), F.lit(3)), F.col("name"))
    return found.select("sample_id", F.format_string("%s_e%03d", "sample_id", keys).alias("element_id"), "name", "value")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS sample_id, name, value FROM (
  SELECT c_custkey, unnest(['hair', 'outfit']) AS name,
    unnest([c_name, 'coat: lining: ' || CASE WHEN c_nationkey % 2 = 0 THEN 'panels: left；seams: row: first: thread: ' || c_mktsegment || '；none: ' ELSE c_mktsegment END || '；hem: 1；2']) AS value FROM customer)
""")
def nested_features(spark, sf_dir):
    """Identity features that nest seven deep in some answers and two in others, empty items left out."""
    c = table(spark, sf_dir, "customer")
    quoted = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"'))
    deep = F.concat(F.lit('{"panels": ["left", "", null, [], {}], "seams": [{"row": {"first": {"thread": '), quoted, F.lit(', "zz": {}}}}, {"none": [""]}]}'))
    lining = F.when(F.col("c_nationkey") % 2 == 0, deep).otherwise(quoted)
    answer = F.concat(F.lit('{"identity_features": {"hair": "'), F.col("c_name"), F.lit('", "outfit": {"coat": {"lining": '), lining, F.lit('}, "empty": [], "hem": [1, "", 2]}}}'))
    found = extraction.elements(c.select(F.col("c_custkey").cast("string").alias("sample_id"), answer.alias("answer")))
    return found.select("sample_id", "name", "value")


# Matches of an assignment: lines of an order that stand on both sides under one number.
MATCHES = """
pred AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_returnflag) AS category FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY l_orderkey, l_linenumber),
gold AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_suppkey % 3 <> 0),
m AS (SELECT k, i, (i + k) % 10 / 10 AS similarity FROM pred JOIN gold USING (k, i) WHERE (i + k) % 4 <> 0)
"""


def _matched(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("index"), F.col("l_returnflag").alias("category"), "l_suppkey")
    pred = line.filter("l_suppkey % 2 = 0").groupBy("k", "index").agg(F.min("category").alias("category"))
    gold = line.filter("l_suppkey % 3 <> 0").select("k", "index").distinct()
    m = pred.join(gold, ["k", "index"]).filter("(index + k) % 4 <> 0").select("k", F.col("index").alias("pred_index"), F.col("index").alias("gold_index"), ((F.col("index") + F.col("k")) % 10 / 10).alias("similarity"))
    return m, pred, gold


_EVALUATED = f"""{MATCHES},
n AS (SELECT k, coalesce(a.n, 0) AS pred_count, coalesce(b.n, 0) AS gold_count FROM (SELECT k, count(*) AS n FROM pred GROUP BY k) a FULL JOIN (SELECT k, count(*) AS n FROM gold GROUP BY k) b USING (k)),
s AS (SELECT n.*, coalesce(x.matched, 0) AS matched, coalesce(x.s, 0) AS avg_similarity, CAST(coalesce(x.good, 0) AS BIGINT) AS good_matches, CASE WHEN gold_count > 0 THEN coalesce(x.matched, 0) / gold_count ELSE 1 END AS coverage, CASE WHEN pred_count > 0 THEN coalesce(x.matched, 0) / pred_count ELSE 1 END AS precision
  FROM n LEFT JOIN (SELECT k, count(*) AS matched, avg(similarity) AS s, count_if(similarity >= 0.65) AS good FROM m GROUP BY k) x USING (k)),
e AS (SELECT *, matched - good_matches AS weak_matches, CASE WHEN coverage + precision > 0 THEN 2 * coverage * precision / (coverage + precision) ELSE 0 END AS f1 FROM s)
"""


@query(f"WITH {_EVALUATED} SELECT * FROM e")
def assignment_metrics(spark, sf_dir):
    """Coverage, precision, F1, mean similarity, good and weak matches by sample."""
    m, pred, gold = _matched(spark, sf_dir)
    return assignment.evaluate(m, pred, gold, "k")


@query(f"WITH {_EVALUATED} SELECT count(*) AS samples, avg(coverage) AS mean_coverage, avg(precision) AS mean_precision, avg(f1) AS mean_f1, sum(matched) / sum(gold_count) AS micro_coverage, sum(matched) / sum(pred_count) AS micro_precision, avg(CASE WHEN matched > 0 THEN avg_similarity END) AS mean_similarity, min(CASE WHEN matched > 0 THEN avg_similarity END) AS min_similarity, max(CASE WHEN matched > 0 THEN avg_similarity END) AS max_similarity FROM e")
def assignment_overall(spark, sf_dir):
    """Means of the samples' metrics and ratios of sums."""
    m, pred, gold = _matched(spark, sf_dir)
    return assignment.overall(assignment.evaluate(m, pred, gold, "k"))


@query(f"WITH {MATCHES} SELECT category, count(*) AS total_pred, count(m.i) AS matched, coalesce(avg(similarity), 0) AS avg_similarity, count(m.i) / count(*) AS precision FROM pred LEFT JOIN m USING (k, i) GROUP BY category")
def precision_by_category(spark, sf_dir):
    m, pred, _ = _matched(spark, sf_dir)
    return assignment.category_precision(pred, m, "k")


@query(f"""
WITH {MATCHES} SELECT k, i AS index, category FROM pred p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = p.k AND m.i = p.i) AND EXISTS (SELECT 1 FROM gold g WHERE g.k = p.k AND abs(g.i - p.i) <= 1)
""")
def relaxed_matches(spark, sf_dir):
    """Unmatched predictions that some gold element of their sample is near."""
    m, pred, gold = _matched(spark, sf_dir)
    return assignment.relaxed_matches(pred, gold, m, "k", 1 - F.abs(F.col("p_index") - F.col("g_index")) * 0.4)


COMPOUND = ("帽子和手套", "长裤及短靴", "红与黑", "花纹", "外套与蓝色腰带")


@query(f"""
WITH g AS (SELECT CAST(p_brand AS VARCHAR) AS k, p_partkey AS i, {_list(COMPOUND)}[p_partkey % 5 + 1] AS name, p_size > 10 AS apart FROM part),
h AS (SELECT *, CASE p_partkey_mod WHEN 0 THEN ['帽子', '手套'] WHEN 1 THEN ['长裤', '短靴'] WHEN 4 THEN ['外套', '蓝色腰带'] ELSE [] END AS halves FROM (SELECT *, i % 5 AS p_partkey_mod FROM g)),
c AS (SELECT k, i, name, -1 AS part FROM h UNION ALL SELECT k, i, halves[p + 1], p FROM (SELECT *, unnest([0, 1]) AS p FROM h WHERE apart AND len(halves) = 2)),
m AS (SELECT DISTINCT k, i, part FROM c WHERE (i + part) % 3 = 0),
t AS (SELECT k, i, count_if(part >= 0) AS parts FROM c GROUP BY k, i), x AS (SELECT k, i, bool_or(part < 0) AS direct, count(*) AS n FROM m GROUP BY k, i)
SELECT t.k, CAST(t.i AS BIGINT) AS gold_index, CAST(CASE WHEN direct THEN 1.0 WHEN n > 0 THEN least(1.0, n / greatest(parts, 1)) ELSE 0.0 END AS DOUBLE) AS coverage FROM t LEFT JOIN x USING (k, i)
""")
def compound_credit(spark, sf_dir):
    """Names of two halves that differ become candidates of their own; partial credit for halves that are matched."""
    p = table(spark, sf_dir, "part")
    gold = p.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("index"), F.element_at(F.array(*map(F.lit, COMPOUND)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"), (F.col("p_size") > 10).alias("apart"))
    found = assignment.expand_compounds(gold, F.col("apart"))
    matches = found.filter("(index + part) % 3 = 0").select("k", F.col("index").alias("gold_index"), "part")
    return assignment.compound_coverage(matches, found, "k")


@query("""
WITH c AS (SELECT conv_id, role, turn, list_distinct(list_filter(string_split(text, ''), lambda c: NOT regexp_matches(c, '^[\\s，。、'':：;；,.!！?？/|（）()\\[\\]{}<>《》-]*$'))) AS x FROM conversations),
s AS (SELECT p.conv_id, p.turn AS i, g.turn AS j, CASE WHEN len(p.x) > 0 AND len(g.x) > 0 THEN greatest(len(list_intersect(p.x, g.x)) / len(list_distinct(list_concat(p.x, g.x))), len(list_intersect(p.x, g.x)) / least(len(p.x), len(g.x))) ELSE 0 END AS s
  FROM c p JOIN c g ON g.conv_id = p.conv_id AND g.role = 'user' WHERE p.role = 'assistant'),
n AS (SELECT conv_id, least(count(DISTINCT i), count(DISTINCT j)) AS n FROM s GROUP BY conv_id)
SELECT conv_id, n AS pairs, CAST(1 AS BOOLEAN) AS whole FROM n
""")
def assignment_sizes(spark, sf_dir):
    """The optimal assignment without a threshold pairs the whole smaller side, and no turn twice."""
    from sparloom.queries import _turns

    a, u = _turns(spark, sf_dir, "assistant"), _turns(spark, sf_dir, "user")
    m = assignment.optimal(a, u, "conv_id", accept=-1.0)
    return m.groupBy("conv_id").agg(F.count("*").alias("pairs"), ((F.count("*") == F.countDistinct("pred_index")) & (F.count("*") == F.countDistinct("gold_index"))).alias("whole"))


@query("""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def neighbour_cosine(spark, sf_dir):
    """Cosine of each vector with the next one."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 5).alias("similarity"))


@query("""
SELECT s.sample_id, s.category, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE CAST(l_orderkey AS VARCHAR) = s.sample_id) AS rule_count
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS category FROM orders WHERE o_orderkey % 20 = 3) s
""")
def template_manifest(spark, sf_dir):
    """Samples with the number of rules that their blank sheets have."""
    return _templates(spark, sf_dir)["manifest"].select("sample_id", "category", "rule_count")


def _templates(spark, sf_dir) -> dict[str, DataFrame]:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 3").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("_row"))
    rules = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sample_id"), F.format_string("rule_%d", "l_linenumber").alias("rule_id"), F.lit("v").alias("value"), F.col("l_linenumber").alias("position")).distinct()
    return templates.templates(o, rules)


@query("""
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS category, 'rule_' || l_linenumber AS rule_id, 'rule_' || l_linenumber AS rule_key, 'v' AS atomic_value, '' AS rule_validity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 20 = 3
""")
def template_audit_sheet(spark, sf_dir):
    """The blank audit sheet: a row for each rule of a sample."""
    return _templates(spark, sf_dir)["audit"].select("sample_id", "category", "rule_id", "rule_key", "atomic_value", "rule_validity")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)),
q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1 AS nth FROM r WHERE l_linenumber % 2 = 1),
u AS (SELECT q.*, CASE WHEN l_partkey % 5 = 0 THEN 'other' ELSE 'left ' || l_partkey END AS old, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'right ' || l_partkey END AS new FROM q WHERE l_partkey % 2 = 0)
SELECT CAST(r.l_orderkey AS VARCHAR) AS path, CAST(r.place AS INTEGER) AS position, coalesce(u.old = 'left ' || r.l_partkey AND u.new <> '', false) AS changed, CASE WHEN u.old = 'left ' || r.l_partkey AND u.new <> '' THEN u.new ELSE 'left ' || r.l_partkey END AS new_value
FROM r LEFT JOIN u ON u.l_orderkey = r.l_orderkey AND u.place = r.place
""")
def rule_corrections(spark, sf_dir):
    """Corrections of position rules, by place or by ordinal, that still fit the rule they change."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 1, F.format_string("Hat%d_Position", "l_linenumber")).otherwise(F.format_string("hat%d", "l_linenumber"))
    rules = line.select(F.col("l_orderkey").cast("string").alias("path"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("position"), name.alias("rule_id"), F.concat(F.lit("left "), F.col("l_partkey").cast("string")).alias("value"), "l_partkey")
    asked = updates.position_rules(rules, only_sides=True)
    u = asked.filter("l_partkey % 2 = 0").select("path", F.col("position_index").alias("ordinal"), F.when(F.col("l_partkey") % 3 == 0, F.col("position_index").cast("string")).alias("position_index"), F.col("rule_id").alias("id"), F.when(F.col("l_partkey") % 5 == 0, "other").otherwise(F.col("value")).alias("old_value"), F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit(" right "), F.col("l_partkey").cast("string"))).alias("corrected_value"))
    return updates.apply_updates(rules.drop("l_partkey"), asked, u).select("path", "position", "changed", "new_value")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS path, 'rule_' || lower(replace(o_orderpriority, '-', '_')) AS rule_id, min(l_linenumber) AS position, 'head' AS location FROM (SELECT o_orderkey, replace(o_orderpriority, ' ', '_') AS o_orderpriority, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity < 40) GROUP BY ALL
""")
def checked_rules(spark, sf_dir):
    """Rules with snake-case ids, the first of each id in its document, values that are missing left out."""
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rules = d.select(F.col("o_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("position"), F.concat(F.lit(" Rule "), "o_orderpriority", F.lit("!")).alias("rule_id"), F.when(F.col("l_quantity") < 40, "v").alias("value"), F.lit(" Head").alias("location"))
    return updates.checked_rules(rules).select("path", "rule_id", "position", "location")


@query("""
WITH f AS (SELECT p_brand, p_type, p_size, p_partkey FROM part), s AS (SELECT a.p_partkey, count(*) AS n FROM f a JOIN (SELECT DISTINCT p_brand, p_type FROM f) b USING (p_brand) WHERE a.p_type = b.p_type GROUP BY ALL)
SELECT p_partkey AS finding, CASE WHEN n > 0 THEN true ELSE false END AS same_type FROM f LEFT JOIN s USING (p_partkey)
""")
def injected_scorer(spark, sf_dir):
    """Alignment with a scorer of one's own in place of the sequence ratio: every part meets its own type."""
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("_row"), F.col("p_partkey").cast("string").alias("finding_id"), F.col("p_brand").alias("sample_id"), F.lit("").alias("category"), F.col("p_type").alias("human_rule_name"), F.col("p_type").alias("expected_value"))
    types = p.select(F.col("p_brand").alias("sample_id"), F.col("p_type").alias("rule_id")).distinct()
    rules = basics.numbered(types, ["sample_id"], ["rule_id"], "position").select(F.lit("").alias("category"), "sample_id", "position", "rule_id", F.col("rule_id").alias("value"))
    found, _ = alignment.align(f, rules, top_k=1, scorer=lambda a, b: char_similarity(a, b, strip_ascii=False))
    return found.select(F.col("_row").alias("finding"), (F.col("atomic_rule_value") == F.col("human_value")).alias("same_type"))


# Documents and images of a data set, made of customers and their nations.
DATASET = """
d AS (SELECT '/data/' || c_custkey || '/s.json' AS path, c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'same' || c_nationkey ELSE 's' || c_custkey END AS sample_id, CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN '/abs/' || c_custkey || '.png' ELSE '/data/' || c_custkey || '/i.png' END AS image, c_custkey % 17 = 0 AS broken, c_custkey % 19 = 0 AS listed FROM customer),
ok AS (SELECT * FROM d WHERE NOT broken AND NOT listed),
i AS (SELECT '/data/' || c_custkey || '/i.png' AS path, CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_custkey // 2 AS VARCHAR) END AS sha256, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 23 <> 0 THEN c_custkey END AS width FROM customer WHERE c_custkey % 4 <> 0),
issues AS (
  SELECT 'error' AS severity, 'invalid_json' AS code, path FROM d WHERE broken
  UNION ALL SELECT 'error', 'invalid_root', path FROM d WHERE listed AND NOT broken
  UNION ALL SELECT 'error', 'invalid_sample_id', path FROM ok WHERE sample_id = ''
  UNION ALL SELECT 'error', 'invalid_source_image', path FROM ok WHERE image = ''
  UNION ALL SELECT 'warning', 'absolute_source_path', path FROM ok WHERE image LIKE '/abs/%'
  UNION ALL SELECT 'error', 'invalid_elements', path FROM ok WHERE c_custkey % 6 = 1
  UNION ALL SELECT 'error', 'invalid_element_value', path FROM ok WHERE c_custkey % 6 = 2
  UNION ALL SELECT 'error', 'invalid_element_name', path FROM ok WHERE c_custkey % 6 = 3
  UNION ALL SELECT 'error', 'invalid_element', path FROM ok WHERE c_custkey % 6 = 4
  UNION ALL SELECT 'warning', 'duplicate_element_names', path FROM ok WHERE c_custkey % 6 = 5
  UNION ALL SELECT 'error', 'missing_source_image', image FROM ok WHERE image <> '' AND image NOT IN (SELECT path FROM i)
  UNION ALL SELECT 'warning', 'unknown_dimensions', image FROM ok WHERE image IN (SELECT path FROM i WHERE width IS NULL)
  UNION ALL SELECT 'error', 'unreadable_image', path FROM i WHERE sha256 IS NULL
  UNION ALL SELECT 'error', 'duplicate_sample_id', path FROM ok WHERE sample_id <> '' AND sample_id IN (SELECT sample_id FROM ok GROUP BY sample_id HAVING count(*) > 1)
  UNION ALL SELECT 'warning', 'duplicate_image', path FROM i WHERE sha256 IN (SELECT sha256 FROM i GROUP BY sha256 HAVING count(*) > 1)
  UNION ALL SELECT 'warning', 'orphan_image', path FROM i WHERE path NOT IN (SELECT image FROM ok))
"""


def _dataset(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sample = F.when(k % 11 == 0, "").when(k % 7 == 0, F.concat(F.lit("same"), "c_nationkey")).otherwise(F.concat(F.lit("s"), k))
    image = F.when(k % 13 == 0, "").when(k % 5 == 0, F.format_string("/abs/%d.png", k)).otherwise("./i.png")
    good = '{"name": "hat", "value": "red"}'
    items = {1: '"none"', 2: '[{"name": "hat", "value": ""}]', 3: '[{"name": "", "value": "red"}]', 4: '["hat"]', 5: f"[{good}, {good}]"}
    elements = F.coalesce(*[F.when(k % 6 == n, F.lit(t)) for n, t in items.items()], F.lit(f"[{good}]"))
    body = F.concat(F.lit('{"sample_id": "'), sample, F.lit('", "source_image": "'), image, F.lit('", "elements": '), elements, F.lit("}"))
    text = F.when(k % 17 == 0, "{").when(k % 19 == 0, F.lit("[1]")).otherwise(body)
    documents = c.select(F.format_string("/data/%d/s.json", k).alias("path"), F.try_parse_json(text).alias("v"))
    images = c.filter("c_custkey % 4 <> 0").select(F.format_string("/data/%d/i.png", k).alias("path"), F.when(k % 23 != 0, F.floor(k / 2).cast("string")).alias("sha256"), F.when((k % 3 != 0) & (k % 23 != 0), k).cast("int").alias("width"), F.when((k % 3 != 0) & (k % 23 != 0), k + 1).cast("int").alias("height"))
    return documents, images


@query(f"WITH {DATASET} SELECT * FROM issues")
def dataset_audit(spark, sf_dir):
    """Problems of sample documents and images, of all sixteen kinds."""
    return audit.audit(*_dataset(spark, sf_dir)).select("severity", "code", "path")


@query(f"""
WITH {DATASET} SELECT (SELECT count(*) FROM issues WHERE severity = 'error') AS error_count, (SELECT count(*) FROM issues WHERE severity = 'warning') AS warning_count, (SELECT count(*) FROM d WHERE path NOT IN (SELECT path FROM issues WHERE severity = 'error')) AS valid_samples,
  (SELECT count(*) FROM d) AS json_files, count(*) AS image_files, CAST(min(width) AS INTEGER) AS min_width, CAST(max(width) AS INTEGER) AS max_width, CAST(min(width) + 1 AS INTEGER) AS min_height, CAST(max(width) + 1 AS INTEGER) AS max_height FROM i
""")
def dataset_audit_summary(spark, sf_dir):
    documents, images = _dataset(spark, sf_dir)
    return audit.audit_summary(audit.audit(documents, images), documents, images)


@query("""
WITH a AS (SELECT s_suppkey, s_nationkey % 6 AS c FROM supplier), n AS (SELECT count(*) AS n FROM a)
SELECT 'row_count' AS problem, CAST(n AS VARCHAR) AS detail FROM n WHERE n <> 12
UNION ALL SELECT 'category_count', c || '=' || count(*) FROM a GROUP BY c HAVING count(*) <> 2
UNION ALL SELECT 'duplicate_sha256', CAST(c AS VARCHAR) FROM (SELECT CAST(s_suppkey // 3 AS VARCHAR) AS c FROM supplier) GROUP BY c HAVING count(*) > 1
UNION ALL SELECT 'hash_differs', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'not_in_manifest', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 5 = 0
UNION ALL SELECT 'not_assigned', 'x' || n_nationkey FROM nation
""")
def smoke_set_problems(spark, sf_dir):
    """Suppliers as a smoke set held against a manifest."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    a = s.select(k.cast("string").alias("sample_id"), (F.col("s_nationkey") % 6).cast("string").alias("category"), F.floor(k / 3).cast("string").alias("sha256"))
    known = s.filter("s_suppkey % 2 = 0 or s_suppkey % 5 <> 0").select(k.cast("string").alias("sample_id"), F.when(k % 2 == 0, "other").otherwise(F.floor(k / 3).cast("string")).alias("sha256"))
    extra = table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("sample_id"), F.lit("h").alias("sha256"))
    return audit.smoke_problems(a, known.unionByName(extra))
