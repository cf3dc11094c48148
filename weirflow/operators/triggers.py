"""Size triggers and schedules, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def size_trigger(commits: DataFrame, threshold: int, key: str = "pipeline", order: str = "seq", size: str = "size") -> DataFrame:
    """Adds fires: how many times a commit's bytes push the ledger of its key past a multiple of the threshold; the remainder stays."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(size).over(w)
    fires = F.floor(total / threshold) - F.floor((total - F.col(size)) / threshold)
    return commits.withColumn("fires", fires.cast("long")).withColumn("ledger", (total % threshold).cast("long"))


def cron_ticks(bounds: DataFrame, every_seconds: int) -> DataFrame:
    """bounds(start, end) -> tick, name of each tick from start on."""
    ticks = bounds.select(F.explode(F.expr(f"sequence(start, end, interval {int(every_seconds)} seconds)")).alias("tick"))
    return ticks.withColumn("name", F.date_format("tick", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
