"""Incremental co-change counts over a stream of commit rows (an extension: the reference works on whole snapshots only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_touches(stream: DataFrame, watermark: str = "28 days", window: str = "7 days") -> DataFrame:
    """(repo, path, window, commits): commits that touch a path per window of event time, from rows (repo, sha, path, at). Rows that arrive more
    than ``watermark`` late are dropped; repeated (repo, sha, path) within it count once."""
    s = stream.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["repo", "sha", "path"])
    return s.groupBy("repo", "path", F.window("at", window)).agg(F.count(F.lit(1)).alias("commits"))


def pairs_of_batch(batch: DataFrame, most: int = 30) -> DataFrame:
    """(repo, a, b, n) of one micro-batch whose commits are complete: what ``foreachBatch`` adds to the running pair counts."""
    d = batch.select("repo", "sha", "path").filter(F.col("path").isNotNull()).distinct()
    lists = d.groupBy("repo", "sha").agg(F.array_sort(F.collect_set("path")).alias("ps")).filter(F.size("ps").between(2, most))
    e = lists.select("repo", "ps", F.explode("ps").alias("a"))
    return e.select("repo", "a", F.explode(F.filter("ps", lambda x: x > F.col("a"))).alias("b")).groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def run_pairs(stream: DataFrame, folder: str, checkpoint: str):
    """Appends each batch's pair counts to parquet under ``folder`` (one directory per batch, so a replayed batch overwrites itself) until the
    stream's available data is used up; returns the finished query. Sum ``n`` over the folder for the counts so far."""

    def sink(batch: DataFrame, number: int) -> None:
        pairs_of_batch(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
