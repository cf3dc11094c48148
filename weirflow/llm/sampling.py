"""Bounded training samples and the fixed fold that is never learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

FOLDS, HELD_OUT = 4, 2
_RANGE = 1 << 30


def held_out(doc_id: Column) -> Column:
    """Whether unsigned crc32 of the id as text, modulo 4, is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def per_class_sample(rows: DataFrame, label: str, most: int, in_all: int | None = None, least: int = 40) -> DataFrame:
    """About ``most`` rows of each value of ``label``, fewer (but at least ``least``) where all values together would have over ``in_all``,
    chosen by a hash of doc_id: a plain filter, the same at every run, whose rate follows the number of rows. Rows without a doc_id or
    label aren't learnt from."""
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    counts = [(r[0], r[1]) for r in rows.groupBy(label).count().collect()]
    if not counts:
        return rows.limit(0)
    if in_all is not None:
        most = min(most, max(least, in_all // len(counts)))
    rates = rows.sparkSession.createDataFrame([(k, min(_RANGE, int(_RANGE * most / n))) for k, n in counts], StructType([StructField("_label", rows.schema[label].dataType), StructField("_rate", LongType())]))
    joined = rows.join(F.broadcast(rates), F.col(label) == F.col("_label"))
    return joined.filter(F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(_RANGE)) < F.col("_rate")).select(*rows.columns)
