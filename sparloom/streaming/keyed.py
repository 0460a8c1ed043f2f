"""State by key across batches, as runs of rows in a folder: what a batch adds is one run, and runs are merged in
levels, so that a batch writes about as much as it brings and reads few runs.

Run ``i`` of level ``l`` holds the rows of ``FAN ** l`` batches, the newest of each key. Runs are sorted by a bucket
of the key's hash, which a batch asks for by its own keys: other row groups are not read. Which runs count follows
from the number of batches alone, so a batch that comes again finds what it found before, and writes the same. Runs
that a larger one has replaced are deleted a batch later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

FAN, BUCKETS = 8, 1024


class KeyedTable:
    """The row of each key that is largest by ``order``, over batches numbered from 0."""

    def __init__(self, path: str, key: list[str], order: str, fan: int = FAN):
        self.path, self.key, self.order, self.fan = path, key, order, fan

    def runs(self, batches: int) -> list[tuple[int, int]]:
        """(level, number) of the runs that together hold the first so many batches."""
        found, done, level = [], 0, 0
        while self.fan ** (level + 1) <= batches:
            level += 1
        for k in range(level, -1, -1):
            size = self.fan**k
            while done + size <= batches:
                found.append((k, done // size))
                done += size
        return found

    def put(self, rows: DataFrame, number: int) -> None:
        """Adds batch ``number``; all earlier ones have been added."""
        self._sweep(rows.sparkSession, number)
        self._write(rows.withColumn("_bucket", self._bucket(self.key)), 0, number)
        level = 1
        while (number + 1) % self.fan**level == 0:
            last = (number + 1) // self.fan**level - 1
            parts = [self._run(rows.sparkSession, rows.schema, level - 1, last * self.fan + k) for k in range(self.fan)]
            self._write(reduce(DataFrame.unionByName, parts), level, last)
            level += 1

    def read(self, spark: SparkSession, schema: StructType, batches: int, keys: DataFrame | None = None) -> DataFrame:
        """The newest row of each key of the first so many batches; ``keys``: only these, of the same names."""
        parts = [self._run(spark, schema, *run) for run in self.runs(batches)]
        if not parts:
            return spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, parts)
        if keys is not None:
            asked = [r[0] for r in keys.select(self._bucket(self.key)).distinct().collect()]  # BUCKETS at most
            rows = rows.filter(F.col("_bucket").isin(asked)).join(keys.select(*self.key).distinct(), self.key, "left_semi").select(*rows.columns)
        return self._newest(rows).drop("_bucket")

    def batches(self, spark: SparkSession) -> int:
        """How many batches have been added."""
        return max([(i + 1) * self.fan**level for level, i in self._found(spark)], default=0)

    def _bucket(self, key: list[str]):
        return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)]).agg(F.max_by(F.struct(*rows.columns), self.order).alias("r")).select("r.*")

    def _write(self, rows: DataFrame, level: int, number: int) -> None:
        self._newest(rows).repartitionByRange("_bucket").sortWithinPartitions("_bucket").write.mode("overwrite").parquet(f"{self.path}/run-{level}-{number}")

    def _run(self, spark: SparkSession, schema: StructType, level: int, number: int) -> DataFrame:
        return spark.read.schema(StructType([*schema.fields]).add("_bucket", IntegerType())).parquet(f"{self.path}/run-{level}-{number}")

    def _folder(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _found(self, spark: SparkSession) -> list[tuple[int, int]]:
        """The runs that are whole."""
        path, fs = self._folder(spark)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return [(int(level), int(i)) for _, level, i in (n.split("-") for n in names if n.startswith("run-") and whole(n))]

    def _sweep(self, spark: SparkSession, batches: int) -> None:
        _, fs = self._folder(spark)
        needed = set(self.runs(batches))
        for level, i in self._found(spark):
            if (level, i) not in needed and (i + 1) * self.fan**level <= batches:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-{level}-{i}"), True)
