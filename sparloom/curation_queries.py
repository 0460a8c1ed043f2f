"""Queries of the curation side over the driver tables: sources and sinks on files that Spark writes from them, text and
tag functions, queues, categories and samples; with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions import imagery, parsing, tags, text
from sparloom.operators import alignment, basics, curation, duplicates, queue, scoring, templates
from sparloom.operators.shared import own_dir
from sparloom.plans import merchandise, products
from sparloom.queries import _tagged_parts, query, table
from sparloom.sinks import writers
from sparloom.sources import documents, layout, pages, tables, workbooks
from sparloom.streaming import follow, posts, sheets


def _folder(spark, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Files whose names follow the order of the key."""
    return df.repartitionByRange(4, key).sortWithinPartitions(key)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'say \"hi\", ' || c_name AS note, CASE WHEN c_nationkey > 3 THEN c_mktsegment ELSE '' END AS c_mktsegment, '' AS missing FROM customer")
def csv_round_trip(spark, sf_dir):
    """Customers written as CSV of fixed columns, for a spreadsheet, and read with cells trimmed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('　 say "hi", '), "c_name", F.lit("  ")).alias("note"), F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    path = _folder(spark, "csv")
    writers.write_csv(c, path, ["c_custkey", "note", "c_mktsegment", "missing"], for_excel=True)
    return tables.read_csv(spark, path).drop("_file", "_row")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS n_chars FROM documents")
def csv_split_rows(spark, sf_dir):
    """Documents as CSV, their texts quoted with all line breaks, read in splits; each text by its digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = _folder(spark, "csv")
    writers.write_csv(d, path, ["doc_id", "text", "source"])
    found = tables.read_csv_split(spark, path, trimmed=False)
    return found.select("doc_id", "source", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT CAST(user_id AS VARCHAR) AS post_id, arg_max(event_type, event_id) AS event_type, CAST(max(event_id) AS VARCHAR) AS event_id FROM events WHERE user_id % 5 <> 0 GROUP BY user_id")
def csv_last_row_of_key(spark, sf_dir):
    """Events as a keyed table: rows without a key are left out, the last row of each key counts."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("post_id"), "event_type", "event_id")
    path = _folder(spark, "csv")
    writers.write_csv(_in_order(e, "event_id"), path, ["post_id", "event_type", "event_id"], strict=True)
    return tables.last_by_key(tables.read_csv(spark, path), "post_id").drop("_file", "_row")


@query("SELECT CAST(user_id AS VARCHAR) AS post_id, count(*) AS n FROM events WHERE user_id % 5 <> 0 GROUP BY ALL")
def csv_filled_keys(spark, sf_dir):
    """The same table with its repeated keys, and with a table that is not there."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("post_id"))
    path = _folder(spark, "csv")
    writers.write_csv(e, path, ["post_id"])
    none = tables.read_csv(spark, f"{path}-none", ["post_id"], missing_ok=True)
    found = tables.with_key(tables.read_csv(spark, path, multi_line=False).unionByName(none), "post_id")
    return basics.count_by(found, "post_id")


@query("SELECT event_id, event_type, value FROM events")
def json_lines_round_trip(spark, sf_dir):
    """Events as JSON lines and CSV of the same rows, read from the first."""
    path = _folder(spark, "rows")
    writers.write_both(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, ["event_id", "event_type"])
    return tables.read_json(spark, f"{writers.current(spark, path)}/jsonl", "event_id long, event_type string, value double")


@query("""
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, kind FROM events, (VALUES ('csv'), ('jsonl')) AS k(kind)
""")
def paired_outputs(spark, sf_dir):
    """Events as JSON lines and CSV, written twice: both views are of the second writing."""
    path, e = _folder(spark, "pair"), table(spark, sf_dir, "events").select("event_id", "event_type")
    writers.write_both(e.filter("event_id % 2 = 0"), path, ["event_id", "event_type"])
    writers.write_both(e, path, ["event_id", "event_type"])
    pair = writers.current(spark, path)
    csv = tables.read_csv(spark, f"{pair}/csv").select("event_id", "event_type", F.lit("csv").alias("kind"))
    rows = tables.read_json(spark, f"{pair}/jsonl", "event_id long, event_type string")
    return csv.unionByName(rows.select(F.col("event_id").cast("string"), "event_type", F.lit("jsonl").alias("kind")))


@query("SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 AS INTEGER) AS page, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 50 AS INTEGER) AS position, CAST(doc_id AS VARCHAR) AS post_id, source FROM documents")
def paged_posts(spark, sf_dir):
    """Documents as pages of posts, lists and dictionaries in turn, read as a stream in two goes of which the second
    goes on where the first ended."""
    path = _folder(spark, "listing")
    placed = basics.global_place(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), [F.col("id")])
    paged = placed.groupBy(F.floor(F.col("_place") / 50).alias("page")).agg(F.sort_array(F.collect_list(F.struct("_place", "id", "source"))).alias("posts"))
    listed = F.to_json(F.transform("posts", lambda p: F.struct(p["id"].alias("id"), p["source"].alias("source"))))
    paged.select("page", F.when(F.col("page") % 2 == 0, listed).otherwise(F.concat(F.lit('{"post": '), listed, F.lit("}"))).alias("value")).write.partitionBy("page").text(f"{path}/pages")
    options = {"location": f"{path}/pages", "fetcher": "sparloom.sources.pages:read_folder", "pages_per_batch": "7"}
    pages.append_pages(spark, options | {"max_pages": "3"}, f"{path}/out", f"{path}/checkpoint")
    rows = pages.append_pages(spark, options, f"{path}/out", f"{path}/checkpoint")
    return rows.select("page", "position", "post_id", F.get_json_object("post", "$.source").alias("source"))


@query("SELECT replace(s_name, '#', '_') AS item FROM supplier UNION ALL SELECT 'n' || s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0")
def line_list(spark, sf_dir):
    """A list file with several items a line and comments."""
    line = F.concat(F.lit("  "), F.replace("s_name", F.lit("#"), F.lit("_")), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" ,\t n"), "s_nationkey")).otherwise(""), F.when(F.col("s_suppkey") % 2 == 0, " # not, this").otherwise(""))
    path = _folder(spark, "lines")
    table(spark, sf_dir, "supplier").select(line.alias("value")).unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))).write.text(path)
    return tables.read_lines(spark, path).select("item")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS sample_id, n_name FROM nation")
def unique_manifest(spark, sf_dir):
    """A manifest whose ids are filled and unique; else reading it is an error."""
    path = _folder(spark, "manifest")
    writers.write_csv(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "sample_id"), path, ["sample_id", "n_name"])
    return tables.read_samples(spark, path).select("sample_id", "n_name")


PACKAGE = "r AS (SELECT n_name AS sample_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position, c_name AS rule_id, CASE WHEN c_custkey % 2 = 0 THEN 'head' ELSE 'body' END AS location, c_mktsegment AS value FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(f"WITH {PACKAGE} SELECT sample_id, CAST(position AS INTEGER) AS position, rule_id, location, value FROM r")
def package_documents(spark, sf_dir):
    """Rules of a sample as one JSON document, written, read again as documents of changing shape, and as rules."""
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rules = d.select(F.col("n_name").alias("sample_id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("rule_id"), F.when(F.col("c_custkey") % 2 == 0, "head").otherwise("body").alias("location"), F.col("c_mktsegment").alias("value"))
    path = _folder(spark, "packages")
    writers.package_documents(rules).repartition("sample_id").write.partitionBy("sample_id").text(path)
    read = documents.read_documents(spark, path)
    sample = F.regexp_extract("path", "sample_id=([^/]*)/", 1)
    return documents.rules(read).select(F.call_function("url_decode", sample).alias("sample_id"), "position", "rule_id", "location", "value")


@query("""
SELECT o_orderpriority AS category, CAST(o_orderkey AS VARCHAR) AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS rules, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 10 END AS qc_pass, 0 AS qc_warn, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS qc_fail FROM orders WHERE o_orderkey % 5 <> 0
""")
def prediction_runs(spark, sf_dir):
    """Run summaries: what one lacks comes from its path; files that are no JSON are left out."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    whole = F.to_json(F.struct(F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("rule_count"), F.struct((k % 10).alias("PASS"), F.lit(2).alias("FAIL")).alias("qc_counts")))
    body = F.when(k % 5 == 0, "{").when(k % 3 == 0, "{}").otherwise(whole)
    d = o.select(F.concat(F.lit("/runs/"), "o_orderpriority", F.lit("/"), k.cast("string"), F.lit("/summary.json")).alias("path"), F.try_parse_json(body).alias("v"))
    return documents.prediction_runs(d).drop("path")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS category, 'r' || k AS rule_id, CAST(o_custkey + k AS VARCHAR) AS value FROM (SELECT *, unnest([0, 1]) AS k FROM orders) WHERE o_orderkey % 4 <> 0
""")
def registered_rules(spark, sf_dir):
    """A registry of samples and the rules of each one's file: equal file names under other roots do not count."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    sample = F.struct(k.alias("sample_id"), F.col("o_orderstatus").alias("category"), F.concat(F.lit("./rules/"), k, F.lit("/rules.json")).alias("atomic_rules"))
    configs = o.filter("o_orderkey % 4 <> 0").groupBy(F.col("o_orderstatus").alias("path")).agg(F.collect_list(sample).alias("samples"))
    configs = configs.select("path", F.parse_json(F.when(F.col("path") == "F", F.to_json("samples")).otherwise(F.to_json(F.struct("samples")))).alias("v"))
    rules = F.array(*[F.struct(F.lit(f" r{n} ").alias(name), (F.col("o_custkey") + n).alias("value")) for n, name in ((0, "id"),)])
    other = F.array(F.struct(F.lit("r1").alias("rule_id"), (F.col("o_custkey") + 1).alias("value")))
    body = F.concat(F.lit('{"atomic_rules": ['), F.substring(F.to_json(rules), 2, 1 << 20))
    body = F.concat(F.regexp_replace(body, r"\]$", ""), F.lit(", "), F.substring(F.to_json(other), 2, 1 << 20), F.lit("}"))
    root = F.explode(F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("/elsewhere/old_rules/"), F.lit("/data/rules/"))).otherwise(F.array(F.lit("/data/rules/"))))
    files = o.select("*", root.alias("root")).select(F.concat("root", k, F.lit("/rules.json")).alias("path"), F.parse_json(F.when(F.startswith("root", F.lit("/else")), F.replace(body, F.lit("r0"), F.lit("old"))).otherwise(body)).alias("v"))
    found = documents.registered_rules(documents.registry(configs), documents.rules(files))
    return found.select("sample_id", "category", "rule_id", "value")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(0 AS INTEGER) AS position, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS value, 'red' AS color FROM part
""")
def element_documents(spark, sf_dir):
    """Element documents: a value under a mistyped key counts, repeated elements are one."""
    p = table(spark, sf_dir, "part")
    one = F.concat(F.lit('{"name": "'), "p_name", F.lit('", '), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"value:": "'), "p_type", F.lit('", '))).otherwise(""), F.lit('"attributes": {"color": "red"}}'))
    d = p.select(F.col("p_partkey").cast("string").alias("path"), F.parse_json(F.concat(F.lit('{"elements": ['), one, F.lit(", "), one, F.lit("]}"))).alias("v"))
    return documents.elements(d, dedupe=True).select("path", "position", "name", "value", "color")


@query("""
SELECT n_name AS path, 'policy' AS section, 'order' AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_name, 'policy', 'region', 'r' || n_regionkey FROM nation UNION ALL SELECT n_name, 'version', '', '3' FROM nation
""")
def settings_documents(spark, sf_dir):
    """Configuration that nothing interprets, as rows."""
    n = table(spark, sf_dir, "nation")
    body = F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("order"), F.concat(F.lit("r"), "n_regionkey").alias("region")).alias("policy"), F.lit(3).alias("version")))
    return documents.settings(n.select(F.col("n_name").alias("path"), F.parse_json(body).alias("v")))


@query("SELECT n_name AS sample_id, c_mktsegment AS category, count(*) AS cells FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def workbook_round_trip(spark, sf_dir):
    """Customers as workbooks by nation and segment, with lists of choices, read again cell by cell."""
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = d.select(F.col("n_name").alias("sample_id"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("rule_id"), F.lit("").alias("result"), "c_custkey")
    made = workbooks.to_workbooks(rows, ["sample_id", "category"], ["rule_id", "result"], ["c_custkey"], {"result": ["correct", "wrong"]})
    cells = made.select(F.concat_ws("/", "sample_id", "category", F.lit("sheet.xlsx")).alias("path"), "content").mapInArrow(workbooks._rows, "path string, source_row int, cells array<string>")
    found = workbooks.records(cells)
    return found.groupBy(F.split("path", "/")[0].alias("sample_id"), F.split("path", "/")[1].alias("category")).agg(F.count_if(F.startswith(F.try_element_at("record", F.lit("rule_id")), F.lit("Customer#"))).alias("cells"))


@query("""
SELECT c_mktsegment AS category, n_name AS sample_id, count(*) AS rule_rows, count_if(c_custkey % 4 <> 0) AS correct_rows, count_if(c_custkey % 4 = 0) AS wrong_rows, 'v3_visible_status' AS schema_version,
  count_if(c_custkey % 3 <> 0) AS qc_pass_rows, 0 AS qc_warn_rows, count_if(c_custkey % 3 = 0) AS qc_fail_rows FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 5 <> 0 GROUP BY ALL
""")
def annotation_products(spark, sf_dir):
    """Reviewers' workbooks by segment and nation merged into products; the summary by sample. A third of the rules has
    no value, a quarter is wrong; the sheets of every fifth nation are not filled in and left out."""
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    filled = lambda c: F.when(F.col("n_nationkey") % 5 != 0, c).otherwise(F.lit(""))
    wrong = F.col("c_custkey") % 4 == 0
    value = {"value": F.when(F.col("c_custkey") % 3 != 0, filled(F.col("c_name"))).otherwise(""), "result": filled(F.when(wrong, "wrong").otherwise("correct"))}
    views = {f"{v}_visible": filled(F.lit("visible")) for v in V.VIEWS} | {f"{v}_status": filled(F.when(wrong, "wrong color").otherwise("correct")) for v in V.VIEWS}
    rows = d.select("c_mktsegment", F.col("n_name").alias("sample_id"), F.col("c_name").alias("rule_id"), *[c.alias(n) for n, c in (value | views).items()], "c_custkey")
    made = workbooks.to_workbooks(rows.withColumn("_sample", F.col("sample_id")), ["c_mktsegment", "_sample"], list(V.GOLD_COLUMNS), ["c_custkey"])
    cells = made.select(F.concat_ws("/", "c_mktsegment", "_sample", F.lit("sheet.xlsx")).alias("path"), "content").mapInArrow(workbooks._rows, "path string, source_row int, cells array<string>")
    return products.merge(cells)["summary"]


@query("""
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'human_visual_findings' WHEN 1 THEN 'atomic_rule_audit' WHEN 2 THEN 'human_to_atomic_rule_mapping' WHEN 3 THEN 'v3_rule_level' ELSE 'unknown' END AS kind, CASE o_orderkey % 5 WHEN 3 THEN 'v3_visible_status' WHEN 4 THEN 'legacy_front_side_back_bool' END AS views, count(*) AS n FROM orders GROUP BY ALL
""")
def header_kinds(spark, sf_dir):
    """Which table a header belongs to."""
    heads = (("finding_id", "view", "element_name"), ("rule_id", "rule_validity", "atomic_value"), ("human_finding_id", "atomic_rule_id", "candidate_match_type"), tuple(V.GOLD_COLUMNS), ("front", "side", "back", "result"))
    header = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == k, F.array(*map(F.lit, h))) for k, h in enumerate(heads)])
    o = table(spark, sf_dir, "orders").withColumn("h", header)
    return o.groupBy(workbooks.schema_guess(F.col("h")).alias("kind"), workbooks.view_schema(F.col("h")).alias("views")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderpriority AS parent, o_orderstatus AS grandparent, 'csv' AS kind FROM orders")
def folder_layout(spark, sf_dir):
    """Orders in a folder for each status and priority; the files' folders tell what they hold."""
    path = _folder(spark, "layout")
    writers.write_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, ["o_orderstatus", "o_orderpriority"])
    files = layout.list_files(spark, path, "*.csv")
    value = lambda c: F.call_function("url_decode", F.substring_index(c, "=", -1))
    return files.select(value("parent").alias("parent"), value("grandparent").alias("grandparent"), F.substring_index("name", ".", -1).alias("kind")).distinct()


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN '/a/' || c_custkey || '/x.xlsx' WHEN c_custkey % 3 = 1 THEN '/b/' || c_custkey || '/x.png' END AS path, c_custkey % 3 = 1 AS image, c_custkey % 3 = 0 AS sheet FROM customer
""")
def best_files(spark, sf_dir):
    """Of each sample the file at the best place, and whether it has an image or a sheet."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    at = lambda a, b: F.concat(F.lit(a), k, F.lit(b))
    places = F.when(F.col("c_custkey") % 3 == 0, F.array(at("/a/", "/x.xlsx"), at("/c/", "/x.txt"))).when(F.col("c_custkey") % 3 == 1, F.array(at("/b/", "/x.png"), at("/c/", "/x.txt"))).otherwise(F.array(at("/c/", "/x.txt")))
    files = c.select(k.alias("key"), F.explode(places).alias("path"))
    best = layout.best_place(files, "key", (r"\.xlsx$", r"\.png$"))
    seen = layout.presence(c.select(k.alias("key")), files, "key", {"image": r"\.png$", "sheet": r"\.xlsx$"})
    return seen.join(best.select("key", "path"), "key", "left")


@query("SELECT event_id, 1 + user_id AS width, 2 + event_id % 4000 AS height FROM events")
def image_sizes(spark, sf_dir):
    """Pixel sizes out of image headers that carry event numbers: every other one a GIF, if its 16 bits hold the width."""
    w, h = F.col("user_id") + 1, F.col("event_id") % 4000 + 2
    four = lambda n: F.lpad(F.hex(n), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(w), four(h), F.lit("0802")))
    low = lambda n: F.concat(F.substring(F.lpad(F.hex(n), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(n), 4, "0"), 1, 2))
    gif = F.unhex(F.concat(F.lit("474946383961"), low(w), low(h)))
    e = table(spark, sf_dir, "events").withColumn("s", imagery.image_size(F.when((F.col("event_id") % 2 == 0) | (w > 0xFFFF), png).otherwise(gif)))
    return e.select("event_id", F.col("s.width").cast("bigint").alias("width"), F.col("s.height").cast("bigint").alias("height"))


@query("""
WITH v AS (SELECT vec_id, list_transform(range(1, 73), lambda i: CAST(floor((embedding[i % 64 + 1] + 1) * 100) AS INTEGER)) AS p FROM embeddings)
SELECT vec_id, lower(lpad(printf('%X', list_sum(list_transform(range(0, 64), lambda k: CASE WHEN p[(k // 8) * 9 + k % 8 + 1] > p[(k // 8) * 9 + k % 8 + 2] THEN CAST(1 AS UBIGINT) << CAST(63 - k AS UBIGINT) ELSE 0 END))::UBIGINT), 16, '0')) AS hash FROM v
""")
def gradient_hashes(spark, sf_dir):
    """Difference hashes of vectors read as grey pixels."""
    e = table(spark, sf_dir, "embeddings")
    single = lambda n: F.lit(n).cast("float")  # noqa: E731  (elements are single-precision, and so are their levels)
    pixels = F.transform(F.sequence(F.lit(1), F.lit(72)), lambda i: F.floor((F.element_at("embedding", i % 64 + 1) + single(1)) * single(100)).cast("int"))
    return e.select("vec_id", imagery.hash_text(imagery.difference_hash(pixels)).alias("hash"))


@query("""
WITH v AS (SELECT vec_id, list_transform(range(0, 16), lambda i: [CAST(floor(abs(embedding[3 * i + 1]) * 800) AS INTEGER) % 256, CAST(floor(abs(embedding[3 * i + 2]) * 800) AS INTEGER) % 256, CAST(floor(abs(embedding[3 * i + 3]) * 800) AS INTEGER) % 256]) AS p FROM embeddings),
s AS (SELECT vec_id, list_avg(list_transform(p, lambda x: CASE WHEN list_max(x) > 0 THEN (list_max(x) - list_min(x)) / list_max(x) ELSE 0 END)) AS sat, [list_avg(list_transform(p, lambda x: x[1])), list_avg(list_transform(p, lambda x: x[2])), list_avg(list_transform(p, lambda x: x[3]))] AS m,
  [list_stddev_pop(list_transform(p, lambda x: x[1])), list_stddev_pop(list_transform(p, lambda x: x[2])), list_stddev_pop(list_transform(p, lambda x: x[3]))] AS d FROM v)
SELECT vec_id, round(sat, 6) AS sat_mean, round((d[1] + d[2] + d[3]) / 3 + list_max(m) - list_min(m), 6) AS colorfulness, sat >= 0.08 AND (d[1] + d[2] + d[3]) / 3 + list_max(m) - list_min(m) >= 18 AS likely_color FROM s
""")
def color_metrics(spark, sf_dir):
    """Saturation and colourfulness of vectors read as pixels; posts that pass the gate are counted elsewhere."""
    level = lambda i, k: (F.floor(F.abs(F.element_at("embedding", 3 * i + k)) * F.lit(800).cast("float")).cast("int") % 256)  # noqa: E731  (single-precision, as the elements are)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(level(i, 1).alias("r"), level(i, 2).alias("g"), level(i, 3).alias("b")))
    m = table(spark, sf_dir, "embeddings").withColumn("m", imagery.color_metrics(pixels))
    return m.select("vec_id", F.round("m.sat_mean", 6).alias("sat_mean"), F.round("m.colorfulness", 6).alias("colorfulness"), "m.likely_color")


@query("SELECT page_id, 'data:image/' || CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'jpeg' END || ';base64,' || base64(encode(url)) AS link FROM pages")
def data_urls(spark, sf_dir):
    """Content as data URLs by the extension of the path."""
    p = table(spark, sf_dir, "pages")
    path = F.when(F.col("page_id") % 3 == 0, "a/b.PNG").when(F.col("page_id") % 3 == 1, "c.webp").otherwise("d")
    return p.select("page_id", imagery.data_url(F.encode("url", "utf-8"), path).alias("link"))


@query("""
SELECT c_custkey, regexp_replace(regexp_replace(lower('x ' || c_name || '!'), '[^a-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS slug, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')) AS snake,
  CASE WHEN c_nationkey % 3 = 0 THEN 'a;' || c_mktsegment WHEN c_nationkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment END AS appended, 'solo ' || c_mktsegment || ' rating:safe' AS asked,
  regexp_replace(c_name, '[A-Za-z#]', '', 'g') || '#' AS compact FROM customer
""")
def text_forms(spark, sf_dir):
    """File names, snake case, lists that an item joins once, tag queries, compacted texts."""
    c = table(spark, sf_dir, "customer")
    listed = F.when(F.col("c_nationkey") % 3 == 0, "a").when(F.col("c_nationkey") % 3 == 1, F.col("c_mktsegment"))
    name = F.concat(F.regexp_replace("c_name", "#", ""), F.lit(" 　，#"))
    return c.select("c_custkey", text.slug(F.concat(F.lit("x "), "c_name", F.lit("!"))).alias("slug"), text.snake_case(F.concat(F.lit(" "), "c_name", F.lit("?"))).alias("snake"), text.append_once(listed, F.col("c_mktsegment")).alias("appended"), text.with_safe_rating(F.concat(F.lit(" solo \t "), "c_mktsegment")).alias("asked"), text.compact_text(name).alias("compact"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value ELSE 0 END AS number, 'k' AS key, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '"word"' ELSE '[1,2]' END AS typed,
  CASE WHEN event_type IN ('click') THEN 'content_policy_or_provider_rejection' ELSE 'runtime_error' END AS rejection, 'e/' || event_id AS portable, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 27 ELSE 701 END AS place, CASE WHEN event_id % 2 = 0 THEN 'skin_body' ELSE 'other' END AS category, CAST(event_id % 11 / 10 AS DOUBLE) AS share, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM events
""")
def scalar_parsers(spark, sf_dir):
    """Numbers or zero, typed parameters, rejections, portable paths, cell columns, categories, bounded numbers, sides."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("　"))).when(k % 4 == 1, "none").when(k % 4 == 2, "")
    given = F.concat(F.lit("k="), F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "word").otherwise("[1,2]"))
    said = F.when(F.col("event_type") == "click", "Blocked by our Safety rules").otherwise("timeout")
    p = parsing.parameter(given)
    return e.select("event_id", parsing.as_float(raw).alias("number"), p["key"].alias("key"), p["value"].alias("typed"), parsing.rejection_kind(said).alias("rejection"), parsing.relative_path(F.concat(F.lit("\\root\\e\\"), k.cast("string")), "/root").alias("portable"), parsing.column_number(F.when(k % 3 == 0, "A1").when(k % 3 == 1, "AB12").otherwise("ZZ3")).alias("place"), parsing.element_category(F.when(k % 2 == 0, " Skin-Body ").otherwise("sea")).alias("category"), parsing.bounded(k % 11 / 10, "share").alias("share"), parsing.position_value(F.when(k % 2 == 0, "left").otherwise("right")).alias("side"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '帽子|围巾|鞋' WHEN 1 THEN '帽子和 围巾' WHEN 2 THEN '长裤|短' ELSE '' END AS parts, CASE p_partkey % 4 WHEN 0 THEN '帽子|围巾　与鞋' WHEN 1 THEN '帽子|围巾' ELSE '' END AS halves, CASE p_partkey % 4 WHEN 0 THEN 'headwear,shoes' WHEN 1 THEN 'headwear' WHEN 2 THEN 'pants' ELSE '' END AS families FROM part
""")
def composite_names(spark, sf_dir):
    """Parts of composite names, halves of compound ones, and the objects they name."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("帽子 与围巾　与鞋", "帽子和 围巾", "长裤与短", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(text.composite_parts(name), "|").alias("parts"), F.array_join(text.compound_halves(name), "|").alias("halves"), F.array_join(text.families(name, V.OBJECT_FAMILIES), ",").alias("families"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'character_tags:' || CASE WHEN p_size % 3 = 0 THEN 'aa_knight|' ELSE '' END || p_brand_tag WHEN p_size % 4 = 1 THEN 'source:https://art.example/' || p_partkey || '/' ELSE 'post:' || p_partkey END AS signature,
  CASE WHEN p_size % 2 = 0 THEN 'hair_color=' || p_type || '|top_color=red' ELSE 'hair_color=' || p_type END AS identity FROM (SELECT *, lower(replace(p_brand, '#', '')) AS p_brand_tag FROM part)
""")
def signatures(spark, sf_dir):
    """What tells a character: specific tags, else the source, else the post; and its identity rules."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    own = F.when(size % 4 == 0, F.concat(F.lit("1girl solo blue_hair "), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(size % 3 == 0, " aa_knight").otherwise(""))).otherwise("1girl solo full_body")
    source = F.when(size % 4 == 1, F.concat(F.lit("see https://Art.example/"), F.col("p_partkey").cast("string"), F.lit("/?x=1#y"))).otherwise("")
    rule = lambda i, v: F.struct(F.lit(i).alias("id"), v.alias("value"))
    rules = F.array(rule("top_color", F.when(size % 2 == 0, " red ").otherwise(" ")), rule("hair_color", F.col("p_type")), rule("note", F.lit("x")))
    return p.select("p_partkey", tags.character_signature(tags.tag_set(own), source, F.col("p_partkey")).alias("signature"), tags.identity_signature(rules).alias("identity"))


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS k, count(*) OVER () AS n FROM nation)
SELECT n_name, CAST(103 // n + CASE WHEN k < 103 % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM o
""")
def even_quotas(spark, sf_dir):
    """A number of samples split evenly over nations, the first ones getting the rest."""
    return basics.even_quotas(table(spark, sf_dir, "nation"), F.lit(103), "n_nationkey").select("n_name", "quota")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n > c_nationkey % 3 AND n <= c_nationkey % 3 + 2")
def sliced_groups(spark, sf_dir):
    """Two customers of each nation after an offset of its own."""
    return basics.ranked_slice(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], F.col("c_nationkey") % 3, 2)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, sf_dir):
    return basics.count_by(table(spark, sf_dir, "events"), "event_type")


@query("SELECT p_name, min(p_partkey) AS first_seen FROM part GROUP BY ALL")
def names_in_order(spark, sf_dir):
    """Distinct names by first appearance."""
    return basics.distinct_in_order(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderkey LIMIT 100")
def pending_orders(spark, sf_dir):
    """The first hundred orders without a returned line, as work that is not done."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return basics.without(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey", 100)


@query("SELECT event_id FROM events WHERE event_type = 'click' UNION ALL (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT (SELECT greatest(0, 400 - count(*)) FROM events WHERE event_type = 'click'))")
def topped_up(spark, sf_dir):
    """Existing rows and as many new ones as are missing to four hundred."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return curation.new_rows(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), 400, "event_id").select("event_id")


@query("SELECT user_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS sources FROM events GROUP BY user_id HAVING count(*) > 1")
def ids_in_sources(spark, sf_dir):
    """Users that several events have, with the kinds of events."""
    return duplicates.ids_in_sources(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT group_first, row_number() OVER (ORDER BY group_first) AS group_id FROM (SELECT min(doc_id) AS group_first FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_group_numbers(spark, sf_dir):
    """Groups of equal texts, numbered by first appearance."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return duplicates.group_numbers(duplicates.exact_groups(d, "h", "doc_id"))


@query("SELECT 'run' AS run_id, s || '_seed' || seed AS job_id, s AS sample_id, seed, sha256('draw it') AS prompt_sha256, 'pending' AS status, '/out/' || s || '_seed' || seed || '.png' AS output_image FROM (SELECT CAST(c_custkey AS VARCHAR) AS s, unnest([7, 11]) AS seed FROM customer)")
def job_manifest(spark, sf_dir):
    """A pending job for each customer and seed."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"))
    return queue.job_manifest(s, [7, 11], "p", "m", "draw it", "v1", "run", "/out").select("run_id", "job_id", "sample_id", "seed", "prompt_sha256", "status", "output_image")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def run_summary(spark, sf_dir):
    """Jobs by status."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("pending").alias("status"))
    return queue.run_summary(o)


@query("SELECT CAST(c_custkey AS VARCHAR) AS sample_id, 'Look.' || chr(10) || chr(10) || '{\"sample_id\":\"' || c_custkey || '\",\"category\":\"' || c_mktsegment || '\",\"atomic_rules\":[{\"id\":\"r\",\"value\":\"' || c_name || '\"}]}' AS prompt FROM customer")
def prompts(spark, sf_dir):
    """A prompt with its sample block."""
    c = table(spark, sf_dir, "customer")
    rules = F.array(F.struct(F.lit("r").alias("id"), F.col("c_name").alias("value")))
    return c.select(F.col("c_custkey").cast("string").alias("sample_id"), templates.prompt("Look.\n", F.col("c_custkey").cast("string"), F.col("c_mktsegment"), rules).alias("prompt"))


@query("""
SELECT p_partkey AS sample_id, array_to_string(list_filter([CASE WHEN p_size % 4 <> 0 THEN 'full_body' END, CASE WHEN p_size % 3 <> 0 THEN 'looking_at_viewer' END, CASE WHEN p_size % 5 = 0 THEN 'standing' END, CASE WHEN p_size % 7 = 0 THEN 'sitting' END, CASE WHEN p_partkey % 3 <> 0 THEN 'multiple_views' END, CASE WHEN p_size % 2 = 0 THEN 'turnaround' END, CASE WHEN p_partkey % 23 < 4 THEN 'official_art' END], lambda x: x IS NOT NULL), ' ') AS key_tags FROM part
""")
def key_tags(spark, sf_dir):
    """The tags that tell a sample, in their fixed order, among the first of them."""
    shown = ("full_body", "looking_at_viewer", "standing", "sitting", "multiple_views", "turnaround", "official_art")
    d = scoring.score(_tagged_parts(spark, sf_dir))
    return d.select("sample_id", F.array_join(F.filter(F.split("key_tags", " "), lambda t: t.isin(*shown)), " ").alias("key_tags"))


@query(f"SELECT c, CAST(n // 6 + CASE WHEN k < n % 6 THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT unnest({list(V.CATEGORIES)}) AS c, unnest(range(6)) AS k), (SELECT count(*) AS n FROM part)")
def quota_counts(spark, sf_dir):
    """Parts under even quotas: every category gets its share."""
    d = scoring.balanced(scoring.score(_tagged_parts(spark, sf_dir)), given=None)
    return d.groupBy(F.col("assigned").alias("c")).agg(F.count("*").alias("n"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_custkey % 2 = 0 THEN '/own/' || c_custkey ELSE '/img/' || c_custkey || '.png' END AS image_path, CASE WHEN c_custkey % 3 = 0 THEN 'plush' ELSE '' END AS already_generated_category FROM customer
""")
def enriched_images(spark, sf_dir):
    """Images with their manifest rows and what is generated already."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    images = c.select(k.alias("sample_id"), F.concat(F.lit("/img/"), k, F.lit(".png")).alias("path"))
    manifest = c.filter("c_custkey % 5 <> 1").select(k.alias("post_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/own/"), k)).otherwise("").alias("image_path"))
    manifest = manifest.unionByName(c.filter("c_custkey % 5 = 1 and c_custkey % 2 = 0").select(k.alias("post_id"), F.concat(F.lit("/own/"), k).alias("image_path")))
    return merchandise.enriched(images, manifest, c.filter("c_custkey % 3 = 0").select(k.alias("sample_id"), F.lit("plush").alias("category"))).select("sample_id", "image_path", "already_generated_category")


@query(f"""
WITH c AS (SELECT unnest({list(V.CATEGORIES)}) AS c, unnest(range(6)) AS k)
SELECT c.c AS primary_category, count(p_partkey) AS total, CAST(coalesce(count_if(p_partkey % 2 = 0), 0) AS BIGINT) AS already_generated, CAST(coalesce(count_if(p_partkey % 2 = 1), 0) AS BIGINT) AS remaining FROM c LEFT JOIN part ON p_partkey % 5 = c.k GROUP BY c.c
""")
def category_summary(spark, sf_dir):
    """Samples of every category, generated and left, also of empty ones."""
    names = F.element_at(F.array(*map(F.lit, V.CATEGORIES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(names.alias("primary_category"), F.when(F.col("p_partkey") % 2 == 0, "plush").otherwise("").alias("already_generated_category"))
    return merchandise.summary(rows)


@query("SELECT CAST(p_partkey AS VARCHAR) AS sample_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS label, p_brand AS brand FROM part")
def assignments_with_manifest(spark, sf_dir):
    """Assignments with the manifest's columns where their own are blank."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    own = p.select(k.alias("sample_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("").alias("label"))
    return merchandise.with_manifest(own, p.select(k.alias("post_id"), F.col("p_type").alias("label"), F.col("p_brand").alias("brand")))


@query("SELECT count(*) AS assignments, count(*) AS with_image, CAST(count_if(p_partkey % 2 = 0) AS BIGINT) AS with_sheet, CAST(count_if(p_partkey % 2 = 0) AS BIGINT) AS packaged, CAST(count_if(p_partkey % 2 = 1) AS BIGINT) AS missing FROM part")
def package_counts(spark, sf_dir):
    """Assignments whose assets are all there, and those that lack one."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    files = p.select(k.alias("sample_id"), F.explode(F.array(F.concat(k, F.lit(".png")), F.when(F.col("p_partkey") % 2 == 0, F.concat(k, F.lit(".xlsx"))))).alias("path")).filter("path is not null")
    return merchandise.packages(p.select(k.alias("sample_id")), files, {"image": (r"\.png$",), "sheet": (r"\.xlsx$",)})[1]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name, NULL AS c_name FROM supplier UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, c_name FROM customer")
def ragged_rows(spark, sf_dir):
    """Rows of tables with different columns."""
    return writers.ragged_union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name"), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name"))


@query("SELECT c_mktsegment AS category, CAST(c_custkey AS VARCHAR) AS value FROM customer")
def queue_lists(spark, sf_dir):
    """Lists of pending ids by category, written and read."""
    path = _folder(spark, "queues")
    writers.write_queues(table(spark, sf_dir, "customer"), path, "c_mktsegment", "c_custkey")
    return spark.read.text(path).select(F.col("c_mktsegment").alias("category"), "value")


@query("""
SELECT place, line FROM (SELECT 0 AS place, '| n_name | n_regionkey |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY n_nationkey), '| ' || n_name || ' \\| | ' || n_regionkey || ' |' FROM nation)
""")
def markdown_report(spark, sf_dir):
    """Nations as a Markdown table."""
    n = table(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit(" |")))
    return writers.markdown_table(n, ["n_name", "n_regionkey"], [F.col("n_nationkey")])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, true AS has_null FROM nation")
def json_reports(spark, sf_dir):
    """One JSON text a row, nulls kept."""
    r = writers.report(table(spark, sf_dir, "nation").withColumn("none", F.lit(None).cast("string")))
    return r.select(F.get_json_object("report", "$.n_nationkey").alias("k"), F.get_json_object("report", "$.n_name").alias("name"), F.col("report").rlike(r'"none"\s*:\s*null').alias("has_null"))


@query("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
def review_sheet(spark, sf_dir):
    """The first fifty rows of a review sheet."""
    return writers.ordered_report(table(spark, sf_dir, "customer"), [F.col("c_mktsegment"), F.desc("c_acctbal"), F.col("c_custkey")], 50).select("c_mktsegment", "c_custkey")


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 1)
SELECT CAST(coalesce(p.user_id, g.user_id) AS VARCHAR) AS user_id, coalesce(p.event_type, g.event_type) AS event_type, CASE WHEN p.event_id IS NULL THEN 'fn' WHEN g.event_id IS NULL THEN 'fp' ELSE 'matched' END AS outcome,
  coalesce(CAST(p.event_id AS VARCHAR), '') AS pred_id, coalesce(CAST(g.event_id AS VARCHAR), '') AS gold_id FROM p FULL JOIN g ON p.user_id = g.user_id AND p.event_type = g.event_type AND p.n = g.n
""")
def matched_events_export(spark, sf_dir):
    """Rows of the bag match flattened for export."""
    from sparloom.operators import events

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    m = events.bag_match(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"], ["event_id"])
    return writers.matched_events(m.select("user_id", "event_type", "outcome", F.col("pred.event_id").alias("pred_id"), F.col("gold.event_id").alias("gold_id")))


@query("SELECT preset, label, CAST(k AS INTEGER) AS priority, 'nation_' || k AS query, n AS n FROM (SELECT 'sheets' AS preset, 'front' AS label, unnest([0, 1]) AS k), (SELECT count(*) AS n FROM nation)")
def query_variants(spark, sf_dir):
    """Query variants in order, beside the size of a table."""
    groups = curation.query_groups({"sheets": {"front": ["nation_0", "nation_1"]}}, spark)
    return groups.join(table(spark, sf_dir, "nation").agg(F.count("*").alias("n")))


ART = {"full_body": "p_size % 2 = 0", "official_art": "p_size % 3 <> 0", "2girls": "p_partkey % 13 = 0", "centaur": "p_partkey % 17 = 0", "3boys": "p_partkey % 19 = 0"}


@query(f"""
SELECT p_partkey AS id, CASE WHEN NOT ({ART["full_body"]}) THEN 'missing_full_body' WHEN NOT ({ART["official_art"]}) THEN 'missing_official_art' WHEN ({ART["2girls"]}) OR ({ART["3boys"]}) THEN 'not_single_human_subject' WHEN {ART["centaur"]} THEN 'non_human_tags:centaur' ELSE 'prefilter_pass' END AS reason,
  NOT ({ART["2girls"]}) AND NOT ({ART["3boys"]}) AS one_subject FROM part
""")
def reject_cascade_art(spark, sf_dir):
    """The gates in the mode for official full-body art, with tags of several subjects."""
    own = F.concat_ws(" ", F.lit("1girl"), *[F.when(F.expr(c), t) for t, c in ART.items()])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), own.alias("tags"), F.lit("safe").alias("rating"), F.lit("900").alias("sample_width"), F.lit("900").alias("sample_height"), F.lit("").alias("width"), F.lit("").alias("height"), F.lit("").alias("source"), F.lit("official_full_body_1").alias("crawl_label"), F.lit("solo full_body official_art").alias("raw_tags"))
    return curation.cascade(p).select("id", "reason", tags.single_subject(tags.tag_set(F.col("tags"))).alias("one_subject"))


@query("""
WITH f AS (SELECT p_partkey, p_brand FROM part), r AS (SELECT p_brand, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY ALL)
SELECT p_partkey AS finding, CASE WHEN n > 1 THEN 'multiple_high_confidence_candidates' ELSE '' END AS warnings, count(*) AS n FROM f JOIN r USING (p_brand), (SELECT unnest(range(1, 6)) AS k) WHERE k <= least(5, n) GROUP BY ALL
""")
def alignment_warnings(spark, sf_dir):
    """Findings that several rules fit well carry a warning on all their rows."""
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("_row"), F.col("p_partkey").cast("string").alias("finding_id"), F.col("p_brand").alias("sample_id"), F.lit("").alias("category"), F.lit("red silk").alias("human_rule_name"), F.lit("red").alias("expected_value"))
    types = p.select(F.col("p_brand").alias("sample_id"), F.col("p_type").alias("t")).distinct()
    rules = basics.numbered(types, ["sample_id"], ["t"], "position").select(F.lit("").alias("category"), "sample_id", "position", F.lit("red").alias("rule_id"), F.lit("red silk").alias("value"))
    found, _ = alignment.align(f, rules, sequences=False)
    return found.groupBy(F.col("_row").alias("finding"), "warnings").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL")
def snapshots(spark, sf_dir):
    """Event files consumed as a stream into snapshots of each user's latest event."""
    path, schema = _folder(spark, "snapshots"), "event_id long, user_id long, event_type string"
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").repartition(3, "event_id").write.parquet(f"{path}/in")
    follow.follow(spark, f"{path}/in", schema, f"{path}/checkpoint", follow.snapshot(f"{path}/out", "user_id", "event_id"), "parquet", per_batch=1).awaitTermination()
    return follow.read_snapshot(spark, f"{path}/out", "user_id", "event_id", spark.read.parquet(f"{path}/in").schema).select("user_id", "event_id", "event_type")


@query("""
WITH RECURSIVE open AS (
    SELECT p_partkey AS o, (p_partkey + 1) // 3 AS i, (p_partkey + 2) // 3 AS s, false AS kept FROM part
    UNION ALL
    SELECT o, i, s, first AS kept FROM (
        SELECT *, bool_or(first) OVER (PARTITION BY i) OR bool_or(first) OVER (PARTITION BY s) AS hit FROM (
            SELECT o, i, s, o = min(o) OVER (PARTITION BY i) AND o = min(o) OVER (PARTITION BY s) AS first FROM open WHERE NOT kept))
    WHERE first OR NOT hit)
SELECT o AS "order", i AS id, 'character_tags:t' || s AS signature FROM open WHERE kept
""")
def accepted_posts(spark, sf_dir):
    """Posts from a stream, three of each id and three of each signature, which overlap: whether one is kept hangs on
    those before it, also across batches."""
    path, p = _folder(spark, "posts"), table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(F.floor((k + 1) / 3).alias("id"), F.concat(F.lit("1girl solo multiple_views turnaround t"), F.floor((k + 2) / 3).cast("string")).alias("tags"), F.lit("safe").alias("rating"), *[F.lit("900").alias(c) for c in ("sample_width", "sample_height", "width", "height")], F.lit("").alias("source"), F.lit("sheets").alias("crawl_label"), F.lit("").alias("raw_tags"), k.alias("order"))
    third = F.floor(3 * F.col("order") / (rows.count() + 1))
    for k in range(3):  # files one after the other: a stream takes them in order of time
        rows.filter(third == k if k < 2 else third >= k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    follow.follow(spark, f"{path}/in", rows.schema, f"{path}/checkpoint", posts.accept_posts(f"{path}/out"), "parquet", per_batch=1).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("order", "id", "signature")


@query("SELECT n_name AS sample_id, count(*) AS rules FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 0 GROUP BY ALL")
def workbook_sync(spark, sf_dir):
    """Workbooks for samples whose output has come, each once, from a stream of outputs with repeats."""
    path = _folder(spark, "sheets")
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rules = d.select(F.lit("c").alias("category"), F.col("n_name").alias("sample_id"), F.col("c_name").alias("rule_id"), F.col("c_custkey").alias("position"))
    done = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.lit("c").alias("category"), F.col("n_name").alias("sample_id"))
    done.unionByName(done).repartition(3).write.parquet(f"{path}/in")
    follow.follow(spark, f"{path}/in", done.schema, f"{path}/checkpoint", sheets.sync_workbooks(rules, f"{path}/out", ["rule_id"]), "parquet", per_batch=1).awaitTermination()
    cells = sheets.workbooks(spark, f"{path}/out").select(F.col("sample_id").alias("path"), "content").mapInArrow(workbooks._rows, "path string, source_row int, cells array<string>")
    return cells.filter("source_row > 1").groupBy(F.col("path").alias("sample_id")).agg(F.count("*").alias("rules"))


MERGED = """
r AS (SELECT n_name AS sample_id, c_custkey AS k, c_name AS rule_id, c_mktsegment AS value FROM customer JOIN nation ON n_nationkey = c_nationkey),
cells AS (
  SELECT sample_id, rule_id, k, k % 11 = 0 AS deleted, k % 7 = 0 AS dropped,
    value AS was_value, CASE WHEN k % 5 = 0 THEN 'edited' ELSE value END AS mine_value, CASE WHEN k % 3 = 0 THEN 'fresh' ELSE value END AS new_value,
    CASE WHEN k % 4 = 1 THEN 'correct' ELSE '' END AS mine_result FROM r),
own AS (
  SELECT sample_id, rule_id,
    CASE WHEN dropped THEN mine_value WHEN deleted THEN new_value WHEN mine_value = was_value THEN new_value ELSE mine_value END AS value, CASE WHEN deleted THEN '' ELSE mine_result END AS result,
    CASE WHEN dropped THEN 'row_removed' WHEN deleted THEN 'row_restored' WHEN k % 15 = 0 THEN 'value' ELSE '' END AS conflicts
  FROM cells WHERE CASE WHEN deleted AND dropped THEN false WHEN deleted THEN new_value <> was_value WHEN dropped THEN mine_value <> was_value OR mine_result <> '' ELSE true END)
"""


@query(f"WITH {MERGED} SELECT * FROM own UNION ALL SELECT DISTINCT sample_id, 'added by hand', 'x', 'wrong', '' FROM r UNION ALL SELECT DISTINCT sample_id, 'added later', 'y', '', '' FROM r")
def workbook_merge(spark, sf_dir):
    """Workbooks that annotators have edited, merged with rules that were made anew: edits stay, conflicts are named."""
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, columns = F.col("source_row"), ["rule_id", "value", "result"]
    written = d.select(F.col("n_name").alias("sample_id"), F.col("c_name").alias("rule_id"), F.col("c_mktsegment").alias("value"), F.lit("").alias("result"), F.col("c_custkey").alias("source_row"))
    added = lambda rule, value, result: written.select("sample_id").distinct().select("sample_id", F.lit(rule).alias("rule_id"), F.lit(value).alias("value"), F.lit(result).alias("result"), F.lit(1 << 40).alias("source_row"))
    by_hand = written.filter(k % 11 != 0).withColumns({"value": F.when(k % 5 == 0, "edited").otherwise(F.col("value")), "result": F.when(k % 4 == 1, "correct").otherwise("")})
    path = _folder(spark, "edited")
    workbooks.to_workbooks(by_hand.unionByName(added("added by hand", "x", "wrong")), ["sample_id"], columns, ["source_row"]).write.parquet(path)
    cells = spark.read.parquet(path).select(F.col("sample_id").alias("path"), "content").mapInArrow(workbooks._rows, "path string, source_row int, cells array<string>")
    edited = workbooks.as_table(workbooks.records(cells), columns).withColumnRenamed("path", "sample_id")
    fresh = written.filter(k % 7 != 0).withColumn("value", F.when(k % 3 == 0, "fresh").otherwise(F.col("value"))).unionByName(added("added later", "y", ""))
    merged = workbooks.merge_edits(written, edited, fresh, ["sample_id", "rule_id"], ["value", "result"])
    return merged.select("sample_id", "rule_id", "value", "result", F.array_join("conflicts", ",").alias("conflicts"))


@query("""
SELECT n_name AS sample_id, CAST(count(*) + 1 AS INTEGER) AS n_rows, CASE WHEN n_nationkey % 4 = 0 THEN 'columns are missing: result' END AS problem, n_nationkey % 4 <> 0 AS listed, CAST(0 AS BIGINT) AS changed
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, n_nationkey
""")
def workbook_choices(spark, sf_dir):
    """Workbooks whose drop-down lists are put on anew: no cell changes, and sheets without the column are named."""
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rules = d.select(F.col("n_name").alias("sample_id"), "n_nationkey", F.col("c_name").alias("rule_id"), F.lit("").alias("result"), F.col("c_custkey").alias("position"))
    path = _folder(spark, "sheets")
    for columns, kept in ((["rule_id"], "n_nationkey % 4 = 0"), (["rule_id", "result"], "n_nationkey % 4 <> 0")):
        workbooks.to_workbooks(rules.filter(kept), ["sample_id"], columns, ["position"]).write.mode("append").parquet(path)
    before = spark.read.parquet(path)
    workbooks.with_choices(before, {"result": ["correct", "wrong"]}, ("rule_id", "result")).write.parquet(f"{path}-listed")
    after = spark.read.parquet(f"{path}-listed")
    cells = lambda files: files.select(F.col("sample_id").alias("path"), "content").mapInArrow(workbooks._rows, "path string, source_row int, cells array<string>")
    changed = workbooks.changed_cells(cells(before), cells(after), ["path"]).groupBy(F.col("path").alias("sample_id")).agg(F.count("*").alias("changed"))
    listed = after.join(before.select("sample_id", F.length("content").alias("was")), "sample_id").select("sample_id", "n_rows", "problem", (F.length("content") > F.col("was")).alias("listed"))
    return listed.join(changed, "sample_id", "left").fillna(0, ["changed"])


@query("""
SELECT CASE WHEN n_nationkey % 7 = 6 THEN 'same' WHEN n_nationkey % 11 <> 10 THEN n_name END AS sample_id, n_nationkey AS n,
  CASE WHEN n_nationkey % 7 = 6 THEN 'duplicate sample_id' WHEN n_nationkey % 11 = 10 THEN 'missing sample_id' WHEN n_nationkey % 5 = 0 THEN 'missing source_image' WHEN n_nationkey % 3 = 0 THEN 'image is not there' END AS problem
FROM nation
""")
def sample_image_files(spark, sf_dir):
    """JSON files of samples that name their images by relative paths, with what is wrong with them."""
    path, n = _folder(spark, "samples"), F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    nation.filter(n % 3 != 0).select(n.alias("of"), F.col("n_name").alias("value")).repartition("of").write.partitionBy("of").text(f"{path}/images")
    images = layout.list_files(spark, f"{path}/images").select(F.substring_index("parent", "=", -1).cast("int").alias("n_nationkey"), F.concat(F.lit("../.././images/"), "parent", F.lit("/"), "name").alias("there"))
    sample = F.when(n % 7 == 6, "same").when(n % 11 != 10, F.col("n_name"))
    image = F.when(n % 5 != 0, F.coalesce("there", F.lit("../../images/none.png")))
    nation.join(images, "n_nationkey", "left").select(n.alias("of"), sample.alias("sample_id"), image.alias("source_image")).repartition("of").write.partitionBy("of").json(f"{path}/samples")
    found = layout.sample_images(spark, f"{path}/samples", f"{path}/images")
    return found.select("sample_id", F.regexp_extract("metadata_path", "of=([0-9]+)", 1).cast("int").alias("n"), "problem")
