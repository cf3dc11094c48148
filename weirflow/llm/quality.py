"""Quality rules: single-document counts, then cross-document line frequency by host.

One pass over the texts measures each document and hashes its normalised lines; only those hashes are shuffled.
A line in more than ``max_docs`` documents of a host is removed from all of them but the one of the least doc_id that passes
the single-document rules, and a document is rejected as depleted if less than ``min_left`` of its words are left. ``quality`` gives the
verdicts, ``cleaned`` the documents that are kept, without the removed lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, stored, window_hashes
from .linededup import split_hot

#: A host's line in over so many documents is boilerplate; shorter lines (in words) are left alone.
MAX_DOCS, MIN_LINE_WORDS = 50, 3
#: A document that keeps a smaller share of its words is depleted.
MIN_LEFT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
BASE = "doc_id long, host string, row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"


def repeated_words(windows: np.ndarray, width: int) -> int:
    """Words that lie in a window found at least twice."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    w = windows[order]
    same = w[1:] == w[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(windows) + width, np.int64)
    edge[:-width] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge) > 0).sum())


def line_hash(line: bytes) -> int:
    """The hash of a line without white space at its ends, A-Z lower-cased."""
    return xxhash.xxh3_64_intdigest(line.strip().lower()) - (1 << 63)


def measure(text: str, hashes: WordHashes, min_line_words: int = MIN_LINE_WORDS) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes and their words."""
    raw = text.encode()
    words = raw.split()
    n_space = len(text) - sum(map(len, text.split("\n"))) + sum(map(text.count, " \t\x0b\x0c\r"))
    seen: set[bytes] = set()
    dup = 0
    own: dict[int, int] = {}
    for line in raw.split(b"\n"):
        key = line.strip()
        if not key:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        n = len(line.split())
        if n >= min_line_words:
            h = line_hash(line)
            own[h] = own.get(h, 0) + n
    repeat = repeated_words(window_hashes(hashes.of(words), WINDOW), WINDOW)
    return len(words), len(text) - n_space, sum(map(text.count, SYMBOLS)), dup, repeat, list(own), list(own.values())


def row_key() -> Column:
    """Tells rows of one doc_id apart: rows with equal keys have the same text and host."""
    return F.xxhash64("doc_id", "text", "source")


def base_metrics(docs: DataFrame, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = [(doc, host, key, *measure(text or "", hashes, min_line_words)) for doc, host, key, text in zip(batch["doc_id"], batch["host"], batch["row_key"], batch["text"], strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BASE.split(", ")])

    return docs.filter("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("host"), row_key().alias("row_key"), "text").mapInPandas(rows, BASE)


def judged(docs: DataFrame, max_docs: int, min_left: float) -> DataFrame:
    """The verdict of each row, with the hashes of the lines that it loses (null for none) and its row_key."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = stored(base_metrics(docs).withColumn("base_failed", failed), "quality")
    each = measured.select("doc_id", "host", "row_key", "base_failed", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("doc_id", "host", "row_key", "base_failed", F.col("l.line_hash").alias("h"), F.col("l.line_words").alias("n"))
    once = each.groupBy("host", "h", "doc_id").agg(F.min("base_failed").alias("base_failed"))
    able = F.when(~F.col("base_failed"), F.col("doc_id"))
    flagged = stored(once.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min(able).alias("first_doc")).filter(F.col("n_docs") > max_docs), "quality-lines")
    n_lines = measured.agg(F.sum(F.size("line_hash"))).first()[0] or 0
    hot, rest = split_hot(flagged, n_lines)
    each = each.drop("base_failed")
    hit = each.join(F.broadcast(hot), ["host", "h"]).unionByName(each.join(rest, ["host", "h"])).filter("first_doc is null or doc_id <> first_doc")
    lost = hit.select("doc_id", "row_key", "h", "n").distinct().groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).agg(F.collect_list("h").alias("gone"), F.sum("n").alias("_lost"))
    every = measured.join(lost, (F.col("doc_id") == F.col("_doc")) & (F.col("row_key") == F.col("_key")), "left").withColumn("removed_words", F.coalesce("_lost", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("removed_words") < F.lit(min_left) * F.col("n_words")
    return every.withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "row_key", "gone")


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, the counts, base_failed, kept, removed_words.

    A null text has no words, so it fails; a null source is a host of its own. Rows without doc_id are left out; rows
    with an equal doc_id are judged each for themselves, and count as one document for a line. Other columns are ignored."""
    return judged(docs, max_docs, min_left).drop("row_key", "gone")


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) that ``quality`` keeps, all columns, their texts without the lines that it removes. Rows
    without doc_id go. Columns may have any names."""

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t: str, lines: Iterable[int]) -> str:
            dropped = set(lines)
            return "\n".join(x for x in t.split("\n") if line_hash(x.encode()) not in dropped)

        return pd.Series([None if g is None else one(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)

    # rows with equal keys have equal verdicts
    verdicts = judged(docs, max_docs, min_left).filter("kept").select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), F.col("gone").alias("_gone")).dropDuplicates(["_doc", "_key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("_key"))
    joined = rows.join(verdicts.withColumnRenamed("_key", "_same"), (F.col("row.doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_same")))
    # only texts that lose a line go through Python
    short = without(F.when(F.col("_gone").isNotNull(), F.col("row.text")), F.col("_gone"))
    text = F.coalesce(short, F.col("row.text")).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
