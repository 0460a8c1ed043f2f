"""Storage that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master (as in tests) gets a folder of its own; on a
    cluster that is an error, as no local folder is shared."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file:///tmp/checkpoints/sparloom"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables that this application has put into the shared folder. Results are lazy and read them, so
    they must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: nothing later repeats it or needs the executors
    that made it."""
    path = f"{own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
