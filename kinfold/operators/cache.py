"""The embedding cache: a Parquet dataset partitioned by model, year_month and job_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(cache: DataFrame, keys: list[str] | None = None, date: str = "embedding_date") -> DataFrame:
    """The newest row of each key; rows without a date come last."""
    w = Window.partitionBy(*(keys or ["model", "paper_id"])).orderBy(F.desc_nulls_last(date))
    return cache.withColumn("r__", F.row_number().over(w)).filter("r__ = 1").drop("r__")


def lookup(cache: DataFrame, papers: DataFrame, models: list[str] | None = None) -> DataFrame:
    """The newest fresh embedding of each paper asked for (paper_id, mdate in ms): one made before the paper changed is stale; without a date or a change there is nothing to be stale by. Models prune partitions."""
    if models is not None:
        cache = cache.filter(F.col("model").isin(models))
    asked = cache.join(papers.select("paper_id", "mdate"), "paper_id")
    fresh = F.col("mdate").isNull() | F.col("embedding_date").isNull() | (F.col("embedding_date") >= F.timestamp_millis(F.col("mdate")))
    return latest(asked.filter(fresh).drop("mdate"))


def missing(cache: DataFrame, papers: DataFrame, model: str) -> DataFrame:
    """Papers without a fresh embedding of the model."""
    return papers.join(lookup(cache, papers, [model]).select("paper_id"), "paper_id", "left_anti")


def delta(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New rows that are newer than the newest cached one, or whose paper isn't cached."""
    old = cache.groupBy("model", "paper_id").agg(F.max("embedding_date").alias("old__"))
    return new.join(old, ["model", "paper_id"], "left").filter(F.col("old__").isNull() | (F.col("embedding_date") > F.col("old__"))).drop("old__")


def append(rows: DataFrame, path: str, job_id: str) -> None:
    rows.withColumn("year_month", F.date_format("embedding_date", "yyyy-MM")).withColumn("job_id", F.lit(job_id)).write.mode("append").partitionBy("model", "year_month", "job_id").parquet(path)
