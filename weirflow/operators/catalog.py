"""Listings, logs, metrics and maintenance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_jobs(jobs: DataFrame, pipeline: str | None = None, states: Iterable[str] | None = None, inputs: Iterable[str] | None = None, output: str | None = None) -> DataFrame:
    """Jobs that all given filters keep. ``inputs``: commits that a job must all have."""
    if pipeline is not None:
        jobs = jobs.filter(F.col("pipeline") == pipeline)
    if states is not None:
        jobs = jobs.filter(F.col("state").isin(*states))
    if output is not None:
        jobs = jobs.filter(F.col("output_commit") == output)
    if inputs is not None:
        jobs = jobs.filter(F.size(F.array_except(F.array(*[F.lit(i) for i in inputs]), F.col("inputs"))) == 0)
    return jobs


def within_history(jobs: DataFrame, versions: DataFrame, history: int) -> DataFrame:
    """Jobs of the last ``history`` versions before the current one, and of it; negative: of all."""
    if history < 0:
        return jobs
    current = versions.groupBy("pipeline").agg(F.max("version").alias("_current"))
    return jobs.join(current, "pipeline").filter(F.col("version") >= F.col("_current") - history).drop("_current")


def version_ancestor(versions: DataFrame, back: int) -> DataFrame:
    """The version ``back`` before the current one of each pipeline that has it."""
    current = versions.groupBy("pipeline").agg(F.max("version").alias("_current"))
    return versions.join(current, "pipeline").filter(F.col("version") == F.col("_current") - back).drop("_current")


def counts_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("pipeline", "state").agg(F.count("*").alias("n"))


def filter_logs(logs: DataFrame, job: str | None = None, pipeline: str | None = None, datum: str | None = None, since: Column | None = None) -> DataFrame:
    if datum is not None and job is None and pipeline is None:
        raise ValueError("a datum filter needs a job or pipeline")
    for name, value in (("job_id", job), ("pipeline", pipeline), ("datum", datum)):
        if value is not None:
            logs = logs.filter(F.col(name) == value)
    return logs if since is None else logs.filter(F.col("t") >= since)


def latency_metrics(calls: DataFrame) -> DataFrame:
    """op, outcome, n, total_ms of each kind of call."""
    return calls.groupBy("op", "outcome").agg(F.count("*").alias("n"), F.sum("ms").cast("long").alias("total_ms"))


def prometheus(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.explode(F.array(
        F.format_string("calls_count{op=\"%s\",outcome=\"%s\"} %d", "op", "outcome", "n"),
        F.format_string("calls_milliseconds_sum{op=\"%s\",outcome=\"%s\"} %d", "op", "outcome", "total_ms"),
    )).alias("line"))


def unreferenced(blobs: DataFrame, references: list[DataFrame]) -> DataFrame:
    """Blobs whose sha none of the tables references."""
    for r in references:
        blobs = blobs.join(r.select("sha").filter("sha is not null"), "sha", "left_anti")
    return blobs


def latest_tags(tags: DataFrame) -> DataFrame:
    """tags(name, seq, ref) -> each name's last binding; a null ref is a deleted tag."""
    return tags.groupBy("name").agg(F.max(F.struct("seq", "ref")).alias("last")).select("name", F.col("last.ref").alias("ref")).filter("ref is not null")


def memory_percent(stats: DataFrame) -> DataFrame:
    return stats.withColumn("mem_perc", F.when(F.col("total") > 0, F.floor(100 * F.col("used") / F.col("total"))).cast("long"))


def busy_share(samples: DataFrame) -> DataFrame:
    """samples(node, t, idle, total), counters -> busy in 1/1000 between consecutive samples."""
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy("t")
    idle, total = (F.col(c) - F.lag(c).over(w) for c in ("idle", "total"))
    return samples.select("node", "t", F.when(total > 0, F.floor(1000 - 1000 * idle / total)).cast("long").alias("busy_permille"))


def live_peers(peers: DataFrame, now: Column, expiry_seconds: int = 90) -> DataFrame:
    return peers.filter((F.col("source") == "static") | (F.col("seen") >= now - F.make_interval(secs=F.lit(expiry_seconds))))


def pick_host(hosts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(label) -> the first live host by name that bears it."""
    each = hosts.filter("live").select("name", F.explode("labels").alias("label"))
    return wanted.join(each, "label").groupBy("label").agg(F.min("name").alias("host"))


def stale_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that a restart has interrupted become failures."""
    cut = F.col("state").isin("queued", "running")
    return jobs.withColumn("reason", F.when(cut, F.lit("daemon restarted mid-job")).otherwise(F.col("reason"))).withColumn("state", F.when(cut, F.lit("failure")).otherwise(F.col("state")))


def corrupt_records(lines: DataFrame, schema: str) -> DataFrame:
    """lines(id, json) that aren't records of the schema."""
    parsed = F.from_json("json", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_r", parsed).filter(F.col("_r._bad").isNotNull()).drop("_r")
