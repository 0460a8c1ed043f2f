"""Writers. Spark's commit protocol makes an overwrite whole or nothing."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.operators.basics import global_place

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, columns: list[str], strict: bool = False, for_excel: bool = False, mode: str = "overwrite") -> None:
    """Fixed columns: missing ones are blank; further ones are left out or, if ``strict``, an error.
    ``for_excel``: a byte order mark before the first header."""
    extra = [c for c in df.columns if c not in columns]
    if strict and (extra or len(df.columns) != len(columns)):
        raise ValueError(f"unexpected or missing columns: {extra or sorted(set(columns) - set(df.columns))}")
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    if for_excel:
        out = out.withColumnRenamed(columns[0], BOM + columns[0])
    out.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def ragged_union(*frames: DataFrame) -> DataFrame:
    """Rows of tables with different columns, in the order in which columns first appear."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


POINTER = "CURRENT"


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _overwrite(spark: SparkSession):
    """The option by which a rename replaces its target in one step, as an array of one."""
    kind = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = spark._jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    return options


def current(spark: SparkSession, path: str) -> str:
    """The folder of the pair that ``write_both`` has put in force last."""
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def write_both(df: DataFrame, path: str, columns: list[str]) -> str:
    """The same rows as JSON lines and as CSV, below the folder that ``current`` names; returns it.

    Both are written to a folder of their own, and a pointer is renamed over the last one when both are whole: what
    stops in between leaves the old pair in force, and no reader sees one of each. The pair before the last stays for
    those who still read it; older ones, and what a stopped write has left, go."""
    spark, version = df.sparkSession, f"version-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    hadoop, fs = _filesystem(spark, path)
    try:
        df.write.parquet(f"{path}/{version}/rows")
        rows = spark.read.schema(df.schema).parquet(f"{path}/{version}/rows")
        write_json(rows, f"{path}/{version}/jsonl")
        write_csv(rows, f"{path}/{version}/csv", columns)
        staged = hadoop.Path(f"{path}/{version}/{POINTER}")
        out = fs.create(staged, True)
        out.write(bytearray(version.encode()))
        out.close()
    except BaseException:
        fs.delete(hadoop.Path(f"{path}/{version}"), True)
        raise
    last = current(spark, path) if fs.exists(hadoop.Path(f"{path}/{POINTER}")) else None
    target = fs.makeQualified(hadoop.Path(f"{path}/{POINTER}"))
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), target, _overwrite(spark))
    fs.delete(hadoop.Path(f"{path}/{version}/rows"), True)
    for entry in fs.listStatus(hadoop.Path(path)):
        name = entry.getPath().getName()
        if name.startswith("version-") and name < (last or version).rsplit("/", 1)[-1]:
            fs.delete(entry.getPath(), True)
    return f"{path}/{version}"


def write_review(df: DataFrame, path: str, order: list[Column]) -> bool:
    """CSV of the columns that the first row in order fills; without rows nothing is written. Whether it was."""
    first = df.orderBy(*order).limit(1).collect()
    if first:
        write_csv(df, path, [c for c in df.columns if first[0][c] is not None])
    return bool(first)


def markdown_table(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """(place, line) of a Markdown table: header, rule and the rows in a total order, placed by ranges."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "place long, line string")
    return head.unionByName(global_place(df, order).select((F.col("_place") + 2).alias("place"), line(map(cell, columns)).alias("line")))


def report(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("report"))


def write_by(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """One folder a key, e.g. category and sample; rows of a folder come from one task."""
    df.repartition(*[F.col(k) for k in keys]).write.mode(mode).partitionBy(*keys).option("header", True).csv(path)


def write_queues(df: DataFrame, path: str, key: str = "primary_category", item: str = "sample_id", mode: str = "overwrite") -> None:
    """Lists of ids, sorted within each file, in one folder a key."""
    df.select(key, F.col(item).cast("string").alias("value")).repartition(F.col(key)).sortWithinPartitions(key, "value").write.mode(mode).partitionBy(key).text(path)


def package_documents(rules: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, document): {"code", "atomic_rules": [{id, location, value}]} in rule order; a rule without a
    location is an error."""
    where = F.when(F.col("location").isin("head", "body"), F.col("location")).otherwise(F.raise_error(F.concat(F.lit("rule without location: "), F.col("rule_id"))))
    one = F.struct("position", F.struct(F.col("rule_id").alias("id"), where.alias("location"), F.col("value")).alias("rule"))
    lists = rules.groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["rule"]).alias("atomic_rules"))
    return lists.select(sample, F.to_json(F.struct(F.col(sample).alias("code"), "atomic_rules")).alias("document"))


def matched_events(matched: DataFrame) -> DataFrame:
    """Flat rows of a bag match: outcome, key columns, and both sides' details."""
    return matched.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in matched.columns])


def ordered_report(df: DataFrame, order: list[Column], limit: int = 0) -> DataFrame:
    """The rows of a report in order; a limit of 0 is none."""
    out = df.orderBy(*order)
    return out.limit(limit) if limit else out
