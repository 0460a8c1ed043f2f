"""What the operators of this subpackage share: columns, words and shared storage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: blank, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Where driver and executors are one process, and only there.
OWN_CHECKPOINTS = "file:///tmp/checkpoints/sparloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a local master
    (as in tests) gets one of its own; on a cluster that is an error, as no local folder is shared."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = OWN_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables and files that this application has put into the shared folder. Results are lazy and
    read them, so they must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mounted_folder(spark: SparkSession, label: str, use: str) -> str:
    """A fresh folder as a path that workers open as files; the shared folder must be mounted on all of them.
    A worker without the mount cannot write there, and reading a file that was written raises."""
    path = fresh_path(spark, label)
    folder = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"workers map {use} into memory: spark.checkpoint.dir must be a mounted folder (file:), not {path}")
    os.makedirs(folder, exist_ok=True)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps neither repeat the work nor
    depend on executors that have gone."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for joins that shuffle both sides. Spark sizes an exploded table by its rows before the explode, and a
    read one by its compressed files, so tables that grow with the input may pass for small ones and be broadcast."""
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The array of maximal runs without white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def count_chars(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars`` (code points)."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def hashed_share(h: Column, share: float) -> Column:
    """Whether a row with this 64-bit hash belongs to a sample of about ``share`` of all hashes."""
    return F.pmod(h, F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


#: Bits of the filter of with_keys and without_keys, at most: 16 MB.
MAX_FILTER_BITS = 1 << 27


def _marked(df: DataFrame, key: str, keys: DataFrame, keys_col: str) -> tuple[DataFrame, Column]:
    """``df`` with what tells whether its key may be in ``keys``, and that condition (false for null keys). It is
    a bitmap of the keys' hashes, of MAX_FILTER_BITS at most and so broadcast; a denser one says so of more
    rows."""
    bits = 1 << 20
    while bits < min(MAX_FILTER_BITS, 16 * keys.count()):
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    page, place, bitmap = fresh_name(df, "_page"), fresh_name(df, "_place"), fresh_name(df, "_bitmap")
    pages = keys.select(slot(F.col(keys_col)).alias("s")).groupBy(F.shiftright("s", 15).alias(page)).agg(F.bitmap_construct_agg((F.col("s") % 32768).cast("long")).alias(bitmap))
    pages = F.broadcast(materialize(pages, "bitmap"))
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col(place) % 8) == 1, F.lit(False)) & F.col(f"`{key}`").isNotNull()
    at = slot(F.col(f"`{key}`"))
    return df.withColumns({page: F.shiftright(at, 15), place: (at % 32768).cast("int")}).join(pages, page, "left"), hit


def with_keys(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``wanted`` (distinct keys), joined with its columns. Only rows that the
    bitmap lets through are shuffled, and the join is exact."""
    marked, hit = _marked(df, key, wanted, wanted_key)
    target = fresh_name(df, "_target")
    own = [F.col(f"`{c}`") for c in df.columns]
    return marked.filter(hit).select(*own).join(wanted.withColumnRenamed(wanted_key, target), F.col(f"`{key}`") == F.col(target)).drop(target)


def without_keys(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """``df`` without the rows whose key is in ``gone`` (null keys stay). Wide rows should not be shuffled to
    drop a few: only those that the bitmap lets through are joined, and the join is exact."""
    marked, hit = _marked(df, key, gone, gone_key)
    own = [F.col(f"`{c}`") for c in df.columns]
    target = fresh_name(df, "_target")
    maybe = marked.filter(hit).select(*own).join(gone.select(F.col(gone_key).alias(target)), F.col(f"`{key}`") == F.col(target), "left_anti")
    return marked.filter(~hit).select(*own).unionAll(maybe)
