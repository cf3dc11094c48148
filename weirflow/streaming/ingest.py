"""Continuous ingestion with Structured Streaming: producers, size triggers, schedules and followed logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_files(snapshot: DataFrame, last: DataFrame) -> DataFrame:
    """Files of snapshot(path, hash, ...) that are new or have another hash."""
    return snapshot.join(last.select("path", "hash"), ["path", "hash"], "left_anti")


def spout(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of new files becomes one commit. ``commit`` gets the batch number, so a batch that runs again can be told apart."""
    return stream.writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else commit(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def size_trigger_stream(commits: DataFrame, threshold: int) -> DataFrame:
    """commits(pipeline, seq, size) -> pipeline, seq, fires; the ledger of each pipeline is keyed state. Commits of one micro-batch are taken in the order of seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        for b in [pd.concat(list(batches)).sort_values("seq")]:
            total = held + b["size"].cumsum()
            fires = total // threshold - (total - b["size"]) // threshold
            held = int(total.iloc[-1])
            yield pd.DataFrame({"pipeline": key[0], "seq": b["seq"], "fires": fires})[fires > 0]
        state.update((held,))

    return commits.groupBy("pipeline").applyInPandasWithState(step, "pipeline string, seq long, fires long", "held long", "append", "NoTimeout")


def cron_stream(spark: SparkSession, seconds: float) -> DataFrame:
    """A tick for each interval of processing time, named by its time."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.filter((F.col("value") % max(1, int(seconds))) == 0).select(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("path")).withColumn("content", F.col("path"))


def follow_logs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Log rows that are written after the query starts."""
    return spark.readStream.schema(schema).parquet(folder)


def push_operations(events: DataFrame, branch: str, repos: dict[str, str]) -> DataFrame:
    """events(url, ref, revision, path, content) of pushes -> repo, path, content, kind: overwrites of the tracked branch's files in each mapped
    repository, and the revision at .git/HEAD. Removed files stay."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in repos.items() for x in kv]), F.col("url"))
    own = events.filter(F.col("ref") == f"refs/heads/{branch}").withColumn("repo", mapped).filter("repo is not null")
    heads = own.select("repo", F.lit(".git/HEAD").alias("path"), F.col("revision").alias("content")).distinct()
    return own.select("repo", "path", "content").unionByName(heads).withColumn("kind", F.lit("overwrite"))
