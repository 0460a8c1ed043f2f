"""Text tables: CSV, JSON lines, line lists. Every cell is text; null is blank; ``_file`` and ``_row`` give
the order of the input, which later windows use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparloom import vocabulary as V
from sparloom.functions.text import characters, clean, stripped


def text_schema(columns) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def ordered(df: DataFrame) -> DataFrame:
    """``df`` of a file source with _file and _row; files are whole in a partition, so _row grows within them."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems find the path (a pattern: anything that fits)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str | None, columns=None, trimmed: bool = True, missing_ok: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header, a byte order mark allowed, quoted cells over several lines allowed; without ``multi_line``
    cells end with the line, and large files are split into tasks. Missing file (or no path) with
    ``missing_ok``: no rows with the given ``columns``."""
    if missing_ok and (path is None or not exists(spark, path)):
        return spark.createDataFrame([], text_schema([*(columns or []), "_file"])).withColumn("_row", F.lit(0).cast("long"))
    raw = ordered(spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("inferSchema", False).csv(path))
    cell = clean if trimmed else lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return raw.select(*[cell(F.col(f"`{c}`")).alias(c) for c in raw.columns if c not in ("_file", "_row")], "_file", "_row")


# Lines of a range that are looked at together, at most.
PIECE = 1_000


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _row, record) of CSV files, in splits: lines are read by byte ranges, and these are cut into pieces of
    ``PIECE`` lines, so that no task holds a range; quotes before a piece, summed over the pieces before it, tell whether
    it begins inside a cell; lines up to the next one that begins outside belong together, across pieces and ranges too.
    Only records of several lines are shuffled by record. _row is the number of the record's first line in its range,
    plus the range's first byte, so it grows within a file."""
    piece = ["_file", "_block", "_piece"]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    lines = lines.withColumns({"_quotes": F.length("value") - F.length(F.replace("value", F.lit('"'))), "_piece": F.floor(F.col("_id") / PIECE)})
    earlier = Window.partitionBy("_file").orderBy("_block", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    in_range = Window.partitionBy("_file", "_block")
    open_at = lines.groupBy(*piece).agg(F.sum("_quotes").alias("n"), F.min("_id").alias("first")).select(*piece, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"), (F.col("_block") - F.min("first").over(in_range)).alias("_shift"))
    inside = Window.partitionBy(*piece).orderBy("_id")
    so_far = F.coalesce(F.sum("_quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(open_at, piece).select(*piece, "_id", "value", (F.col("_id") + F.col("_shift")).alias("_row"), ((F.col("_before") + so_far) % 2 == 0).alias("_first"), "_quotes")
    placed = placed.withColumn("_of", F.max(F.when(F.col("_first"), F.col("_row"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    carried = placed.groupBy(*piece).agg(F.max("_of").alias("n")).select(*piece, F.max("n").over(earlier).alias("_carried"))
    placed = placed.join(carried, piece).withColumn("_of", F.coalesce("_of", "_carried"))
    single = F.col("_first") & (F.col("_quotes") % 2 == 0)
    of_one = placed.filter(single).select("_file", "_row", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("_row", "value")))
    of_many = placed.filter(~single).groupBy("_file", F.col("_of").alias("_row")).agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("record"))
    return of_one.unionByName(of_many).withColumn("record", F.regexp_replace("record", "\\r$", ""))


def read_csv_split(spark: SparkSession, path: str, trimmed: bool = True) -> DataFrame:
    """The rows of ``read_csv``, quoted line breaks included, with large files split into tasks. Quotes must be those
    of quoted cells (doubled inside them): a lone quote within a bare cell needs the whole-file reader. Files share one
    header; a cell that the row lacks is blank, cells beyond the header are left out."""
    options = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "false"}
    columns = spark.read.options(**options).csv(path).columns
    names = [f"c{k}" for k in range(len(columns))]
    rows = csv_records(spark, path).filter("_row > 0 and record <> ''")
    cells = F.from_csv("record", ", ".join(f"{n} string" for n in names), {"escape": '"', "multiLine": "true"})
    cell = clean if trimmed else lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parsed = rows.select("_file", "_row", cells.alias("_cells"))
    return parsed.select(*[cell(F.col(f"_cells.{n}")).alias(c) for n, c in zip(names, columns, strict=True)], "_file", "_row")


def last_by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows with a filled key, the last one of each."""
    latest = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_row"))
    return df.filter(F.col(key) != "").withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows with a filled key."""
    return df.filter(F.col(key) != "")


def read_json(spark: SparkSession, path: str | None, schema: str, lines: bool = True, missing_ok: bool = True) -> DataFrame:
    """JSON lines (blank lines are skipped) or, with ``lines`` off, one array or object a file."""
    if missing_ok and (path is None or not exists(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_lines(spark: SparkSession, path: str, separators: str = characters("," + V.WHITE) + "+") -> DataFrame:
    """Items of a list file: # starts a comment; items stand on lines or between separators."""
    raw = ordered(spark.read.text(path))
    items = F.posexplode(F.split(stripped(F.split("value", "#")[0]), separators)).alias("_place", "item")
    return raw.select("_file", "_row", items).filter("item <> ''").select("item", "_file", "_row", "_place")


def read_samples(spark: SparkSession, path: str, key: str = "sample_id") -> DataFrame:
    """A manifest in which every key must be filled and unique; otherwise reading it fails."""
    rows = read_csv(spark, path)
    times = F.count("*").over(Window.partitionBy(key))
    wrong = F.when(F.col(key) == "", F.lit("blank id in manifest")).when(times > 1, F.concat(F.lit("duplicate id in manifest: "), F.col(key)))
    return rows.withColumn("_wrong", wrong).filter(F.when(F.col("_wrong").isNotNull(), F.raise_error(F.col("_wrong")).cast("boolean")).otherwise(F.lit(True))).drop("_wrong")
