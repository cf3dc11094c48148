"""Line dedup: lines found in several documents are dropped from all but one of them. DataFrame operations only.

Each document's distinct long keys are exploded as 128-bit hashes, counted in two steps (by key and document, then by
key with map-side sums, so a key that every document holds is no hot group), and the keys over the threshold are
joined back. Keys held by very many documents, whose number is bounded, are joined by broadcast; the others have few
rows each. Dropped positions come together by document and the text is rebuilt from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, key_hash, let, line_key, stored

MIN_CHARS, MIN_DOCS = 20, 3
#: A key in over so many documents is hot, and so is one above this share of all rows; at most HOT_KEYS keys can be.
HOT_DOCS, HOT_KEYS = 2_000, 50_000


def document_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def split_hot(counted: DataFrame, n_rows: int, count: str = "n_docs") -> tuple[DataFrame, DataFrame]:
    """Keys so frequent that a join must not send their rows to one task, at most HOT_KEYS as each has over
    n_rows / HOT_KEYS of the rows, and the others."""
    limit = max(HOT_DOCS, n_rows // HOT_KEYS)
    return counted.filter(F.col(count) > limit), counted.filter(F.col(count) <= limit)


def flagged_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """keys(doc_id, h1, h2) -> h1, h2, n_docs, last_doc of those in at least ``min_docs`` documents."""
    once = keys.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns with the kept text, and n_lines, n_dropped.

    Rows with a null doc_id belong to no document: they pass unchanged and count for nothing. Rows with an equal doc_id are
    one document for the counts and each lose the same keys. A null or empty text is one empty line and becomes
    empty. Columns named n_lines or n_dropped in the input are replaced."""
    docs = docs.drop("n_lines", "n_dropped")
    hashed = F.transform(document_lines(F.col("text")), lambda line: let(line_key(line), lambda k: F.when(F.char_length(k) >= min_chars, key_hash(k))))
    lines = docs.filter("doc_id is not null and length(text) > 0").select("doc_id", hashed.alias("keys"))
    each = lines.select("doc_id", F.posexplode("keys").alias("pos", "k")).filter("k is not null").select("doc_id", "pos", "k.h1", "k.h2")
    each = stored(each, "line-keys")
    flagged = stored(flagged_keys(each, min_docs), "line-flags")
    hot, rest = split_hot(flagged, each.count())
    hit = each.join(F.broadcast(hot), ["h1", "h2"]).unionByName(each.join(rest, ["h1", "h2"]))
    dropped = hit.filter("doc_id <> last_doc").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("pos").alias("_gone"))

    # the row as a struct, so that no column's name clashes
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(dropped, F.col("row.doc_id") == F.col("_doc"), "left")
    result = let(
        F.struct(document_lines(F.col("row.text")).alias("lines"), F.col("_gone").alias("gone")),
        lambda x: F.struct(
            F.size(x["lines"]).cast("long").alias("n_lines"),
            F.when(
                x["gone"].isNotNull(),
                F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"]), lambda i: F.element_at(x["lines"], i + 1)), "\n"),
            ).alias("text"),
        ),
    )
    joined = joined.select("row", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"), result.alias("r"))
    text = F.coalesce("r.text", "row.text", F.lit("")).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], F.col("r.n_lines").alias("n_lines"), "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
flagged AS (SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.last_doc AS gone FROM lines l LEFT JOIN flagged f USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
