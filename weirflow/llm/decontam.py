"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame operations only.

Items are partitioned by their number of shingles into bands. Each band has a MinHash permutation, a number of values and a
cutoff of its own: an item is indexed under its least values in the band's permutation, one more than the shingles that a
document may lack of the band's largest item. Whichever shingles are missing, a document that contains enough of the item holds
one of those values, so the search misses nothing however long the document is. A document's shingles beyond the cutoff of every
band are dropped before anything is exploded. Candidates are verified by counting the item's shingles that the document holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, documents, let, stored
from .linededup import split_hot

SHINGLE, CONTAINMENT = 5, 0.75
#: A table of the index is broadcast while it has at most so many rows of 40 bytes; beyond that it is joined by shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    clean = F.btrim(F.translate(ascii_lower(F.coalesce(text, F.lit(""))), ASCII_SPACE[1:], " " * (len(ASCII_SPACE) - 1)))
    return let(clean, lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " +")))


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """The distinct 64-bit hashes of runs of ``width`` words; of all words where there are fewer; none without words."""
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < width, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))
        .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(width)])))),
    )


def allowed_missing(n: Column, containment: float) -> Column:
    return F.floor(n * F.lit(1 - containment) + F.lit(1e-9)).cast("int")


def permuted(h: Column, band: int) -> Column:
    """The value of a hash in the permutation of a band."""
    return h.bitwiseXOR(F.lit((band + 1) * 0x9E3779B97F4A7C15 % (1 << 63)))


def in_band(band: int) -> Callable[[Column], Column]:
    return lambda h: permuted(h, band)


def benchmark_index(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """items(item_id, text) -> item_id, variant, size_band, n, need, shingles of each different text; two texts under one item_id
    are told apart by variant. Items without words match nothing and are left out."""
    sized = items.filter("item_id is not null").select("item_id", F.array_sort(shingle_hashes(F.col("text"))).alias("shingles")).withColumn("n", F.size("shingles")).filter("n > 0")
    banded = sized.withColumn("variant", F.xxhash64("shingles")).dropDuplicates(["item_id", "variant"]).withColumn("size_band", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    return banded.withColumn("need", F.col("n") - allowed_missing(F.col("n"), containment))


def probe_values(index: DataFrame, containment: float) -> tuple[DataFrame, dict[int, int]]:
    """size_band, h of the values that the items of each band are indexed under, and the cutoff of each band in its permutation. The bands
    are few: one for each power of two."""
    tops = {r["size_band"]: r["top"] for r in index.groupBy("size_band").agg(F.max("n").alias("top")).collect()}
    value = F.lit(None).cast("array<bigint>")
    for band, top in tops.items():
        turn = in_band(band)
        low = F.slice(F.array_sort(F.transform("shingles", turn)), 1, int(top * (1 - containment) + 1e-9) + 1)
        value = F.when(F.col("size_band") == band, F.transform(low, turn)).otherwise(value)
    probe = stored(index.select("size_band", F.explode(value).alias("h")).distinct(), "bench-probe")
    cutoffs = {}
    for band in tops:
        cutoffs[band] = probe.filter(F.col("size_band") == band).agg(F.max(permuted(F.col("h"), band))).first()[0]
    return probe, cutoffs


def _met(rows: DataFrame, table: DataFrame, n_table: int, n_docs: int, keys: list[str]) -> DataFrame:
    """rows joined with a table of the index: by broadcast within its bound, else by shuffle, without the keys that very many rows have,
    whose number is bounded."""
    if n_table <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    counted = table.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.count("*").alias("n_docs")), keys)
    hot, _ = split_hot(counted, n_docs)
    hot = stored(hot.select(*keys), "bench-hot")
    often = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")) if hot.count() <= BROADCAST_ROWS // 4 else table.join(hot, keys, "left_semi")
    return rows.join(often, keys).unionByName(rows.join(table.join(F.broadcast(hot), keys, "left_anti"), keys))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles of each pair in which the document holds at least ``containment`` of the
    item's distinct five-word shingles.

    Null or empty texts hold nothing. Rows with an equal doc_id are one document, which holds what any of its texts holds. Rows
    with an equal item_id are one item, found if one of its texts is; the counts are those of the text of which most is held. Rows
    without doc_id or item_id are left out, an empty table gives an empty result, other columns are ignored."""
    index = stored(benchmark_index(items, containment), "bench-index")
    probe, cutoffs = probe_values(index, containment)
    sets = docs.filter("doc_id is not null").select("doc_id", "text")
    if not cutoffs:
        return sets.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_shingles int")
    # MinHash: only values up to a band's largest indexed one can meet the band
    near = lambda h: reduce(lambda a, b: a | b, [permuted(h, band) <= F.lit(c) for band, c in sorted(cutoffs.items())])
    low = sets.select("doc_id", F.explode(F.filter(shingle_hashes(F.col("text")), near)).alias("h"))
    n_probe, n_full = probe.count(), index.agg(F.sum("n")).first()[0]
    suspects = stored(_met(low, probe, n_probe, n_probe, ["h"]).select("doc_id", "size_band").distinct(), "bench-suspects")

    # exact: the shared shingles of each suspect with each item of a size that it met
    full = index.select("size_band", "item_id", "variant", "n", "need", F.explode("shingles").alias("h"))
    held = sets.join(suspects, "doc_id").select("doc_id", "size_band", F.explode(shingle_hashes(F.col("text"))).alias("h"))
    shared = _met(held, full, n_full, n_full, ["size_band", "h"]).groupBy("doc_id", "item_id", "variant", "n", "need").agg(F.count_distinct("h").alias("n_shared")).filter("n_shared >= need")
    best = shared.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n"), "n_shared", "n")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", F.col("best.n").alias("n_shingles"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items that they contain."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sizes AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n) AS INTEGER) AS n_shingles
FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' JOIN sizes ON sizes.item_id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n)
"""
