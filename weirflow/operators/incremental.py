"""Incremental evaluation: which datums to skip, how outputs merge, what a job counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .view import concatenated


def skip_test(datums: DataFrame, dedup: DataFrame, reprocess: bool = False) -> DataFrame:
    """Adds skipped: the last record of the datum is a success (recovered runs again) with an equal hash. The transform isn't part of it."""
    last = dedup.filter("outcome = 'success'").select("datum_id", F.col("hash").alias("_hash")).distinct()
    joined = datums.join(last, "datum_id", "left")
    same = F.lit(False) if reprocess else F.coalesce(F.col("_hash") == F.col("hash"), F.lit(False))
    return joined.withColumn("skipped", same).drop("_hash")


def merge_outputs(fresh: DataFrame, carried: DataFrame, transform_hash: str) -> DataFrame:
    """fresh(datum_ord, path, content), carried(datum_ord, path, content, transform_hash) -> path, content, n_parts, in datum order.

    A carried file yields to fresh output at its path only if another transform made it."""
    written = fresh.select("path").distinct().withColumn("_fresh", F.lit(True))
    stale = F.col("_fresh").isNotNull() & (F.col("transform_hash") != transform_hash)
    kept = carried.join(written, "path", "left").filter(~stale)
    every = fresh.select("datum_ord", "path", "content").unionByName(kept.select("datum_ord", "path", "content"))
    return every.groupBy("path").agg(concatenated("content", "datum_ord").alias("content"), F.count("*").alias("n_parts"))


def job_counters(records: DataFrame, by: str = "job_id") -> DataFrame:
    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    return records.groupBy(by).agg(n("success").alias("processed"), n("recovered").alias("recovered"), n("failed").alias("failed"), n("skipped").alias("skipped"))


def job_progress(records: DataFrame, by: str = "job_id") -> DataFrame:
    """total, done, failed, running, queued, and the mean milliseconds of those that ran."""
    done = F.count_if(F.col("state").isin("success", "recovered", "failed", "skipped"))
    running, total = F.count_if(F.col("state") == "running"), F.count("*")
    ran = F.when((F.col("state") != "skipped") & (F.col("ms") > 0), F.col("ms"))
    return records.groupBy(by).agg(total.alias("total"), done.alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), running.alias("running"), (total - done - running).alias("queued"), F.floor(F.sum(ran) / F.count(ran)).cast("long").alias("avg_ms"))


STATE_RANK = {"failed": 0, "recovered": 1, "success": 2}


def state_rank(state: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv]), state), F.lit(3))


def datum_page(datums: DataFrame, page: int, size: int, job: str = "job_id") -> DataFrame:
    """Page ``page`` of each job's datums, the failed first; size 0 is all. A page past the last has no rows."""
    order = Window.partitionBy(job).orderBy(state_rank(F.col("state")), "datum_id")
    ranked = datums.withColumn("pos", F.row_number().over(order).cast("long") - 1)
    return ranked if size == 0 else ranked.filter(F.floor(F.col("pos") / size) == page)


def check_page(total: int, page: int, size: int) -> int:
    """The number of pages; an error for a page that doesn't exist."""
    pages = 0 if not size else -(-total // size)
    if page and page >= pages:
        raise IndexError(f"page {page} of {pages}")
    return pages


def failure_reason(records: DataFrame, by: str = "job_id") -> DataFrame:
    """The failed datums' reasons in datum order, the last 4000 characters."""
    parts = F.array_sort(F.collect_list(F.struct("datum_id", F.concat(F.lit("datum "), "datum_id", F.lit(" failed: "), "reason").alias("t"))))
    return records.filter("state = 'failed'").groupBy(by).agg(F.right(F.array_join(F.transform(parts, lambda p: p["t"]), "; "), F.lit(4000)).alias("reason"))
