"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents but for the last. Every stage works on all
that the one before has kept; it is written as Parquet in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import documents, stored
from weirflow.llm.decontam import contaminated
from weirflow.llm.linededup import dedup_lines
from weirflow.llm.ngram_join import similar_documents
from weirflow.llm.packing import pack_documents
from weirflow.llm.quality import cleaned


def counted(docs: DataFrame) -> DataFrame:
    """With the number of characters of the texts as they are now, in the column that documents have for it."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, without the lines that are above limits; the others go, and so do rows without doc_id."""
    return counted(cleaned(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the lines that the operator keeps and their number of characters. Columns that are named as the operator's
    counts pass unchanged."""
    own = {c: f"_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = dedup_lines(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in own.items()]))
    return counted(kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns]))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the least doc_id; of rows that repeat a doc_id the first by text. Rows without
    doc_id go."""
    kept = similar_documents(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = stored(kept, "representatives")
    if kept.filter("rows > 1").isEmpty():
        return docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.join(kept, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = Window.partitionBy("row.doc_id").orderBy(F.col("row.text").asc_nulls_last())
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    bad = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Packing counts tokens of a learnt vocabulary, which SQL can't; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
