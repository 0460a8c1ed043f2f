"""The state of every sample in the generation queue, and job manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States in order of precedence; the last holds what nothing else does.
STATES = ("existing", "attempted", "ready", "atomic_errors", "waiting")


def state(existing: Column, attempted: Column, ready: Column, failed: Column) -> Column:
    return F.when(existing, STATES[0]).when(attempted, STATES[1]).when(ready, STATES[2]).when(failed, STATES[3]).otherwise(STATES[4])


def partition(samples: DataFrame, existing: DataFrame, attempted: DataFrame, ready: DataFrame, failed: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with their state, by presence of their key in four tables."""
    flags = ("_existing", "_attempted", "_ready", "_failed")
    d = reduce(lambda x, p: x.join(p[0].select(key).distinct().withColumn(p[1], F.lit(True)), key, "left"), zip((existing, attempted, ready, failed), flags, strict=True), samples)
    return d.withColumn("state", state(*[F.coalesce(f, F.lit(False)) for f in flags])).drop(*flags)


def job_manifest(samples: DataFrame, seeds: list[int], provider: str, model: str, prompt: str, version: str, run_id: str, root: str) -> DataFrame:
    """One pending job for each sample and seed (the seeds are a parameter): ids, hashes and the output's path."""
    d = samples.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    job = F.format_string("%s_seed%d", F.col("sample_id"), F.col("seed"))
    return d.select(F.lit(run_id).alias("run_id"), job.alias("job_id"), "sample_id", *[c for c in ("source_image", "metadata_json") if c in samples.columns], F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.sha2(F.lit(prompt), 256).alias("prompt_sha256"), F.lit(version).alias("prompt_version"), "seed", F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.concat(F.lit(root.rstrip("/") + "/"), job, F.lit(".png")).alias("output_image"))


#: Allowed changes of a job's status.
TRANSITIONS = {"pending": ("running", "skipped"), "running": ("succeeded", "failed"), "failed": ("pending",), "succeeded": (), "skipped": ()}


def transition(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after one event each (job_id, to): changes that are not allowed leave a job as it is."""
    d = jobs.join(events, "job_id", "left")
    allowed = reduce(lambda a, p: a | ((F.col("status") == p[0]) & F.col("to").isin(*p[1])) if p[1] else a, TRANSITIONS.items(), F.lit(False))
    ok = F.coalesce(allowed, F.lit(False))
    return d.withColumns({"attempt": F.col("attempt") + F.when(ok & (F.col("to") == "running"), 1).otherwise(0), "status": F.when(ok, F.col("to")).otherwise(F.col("status"))}).drop("to")


def run_summary(jobs: DataFrame, column: str = "status") -> DataFrame:
    return jobs.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)
