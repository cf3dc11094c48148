"""Views: the files of a revision, from an ordered log of append, overwrite and delete operations.

A log has the columns path, seq (its order), kind, content and any others. Resolving needs no window: the last reset of
each path is a small aggregate that is joined back, so a path with very many appends is split over tasks until
its contents are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def live_parts(ops: DataFrame) -> DataFrame:
    """The operations whose content is part of the view: from the last overwrite or delete of a path on, deletes excluded."""
    resets = ops.filter(F.col("kind") != "append").groupBy(F.col("path").alias("_path")).agg(F.max("seq").alias("_reset"))
    joined = ops.join(resets, F.col("path") == F.col("_path"), "left")
    kept = F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")) | ((F.col("seq") == F.col("_reset")) & (F.col("kind") == "overwrite"))
    return joined.filter(kept & (F.col("kind") != "delete")).drop("_path", "_reset")


def concatenated(value: str = "content", order: str | list[str] = "seq") -> Column:
    """Aggregate: the values in the order given, as one string."""
    keys = [order] if isinstance(order, str) else order
    parts = F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("_v"))))
    return F.array_join(F.transform(parts, lambda p: p["_v"]), "")


def resolve_view(ops: DataFrame) -> DataFrame:
    """path, content, n_parts of each file."""
    return live_parts(ops).groupBy("path").agg(concatenated().alias("content"), F.count("*").alias("n_parts"))


def after_barrier(ops: DataFrame, commits: DataFrame) -> DataFrame:
    """ops(commit_no) after the last empty commit of the chain: an empty commit hides all before it, itself included."""
    barrier = commits.filter("empty").agg(F.coalesce(F.max("commit_no"), F.lit(-1)).alias("_barrier"))
    return ops.join(F.broadcast(barrier), F.col("commit_no") > F.col("_barrier")).drop("_barrier")


def list_files(view: DataFrame) -> DataFrame:
    """path, size, hash of each file of view(path, content)."""
    return view.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


def listing_prefix(pattern: str) -> str:
    """The prefix of a listing pattern, which is a prefix and one star."""
    if "*" not in pattern or any(c in pattern.split("*", 1)[0] for c in "?["):
        raise ValueError(f"a listing pattern is a prefix and *: {pattern!r}")
    return pattern.split("*", 1)[0].lstrip("/")


def file_history(ops: DataFrame, path: str, commits: DataFrame, limit: int | None = None, block: int = 4096) -> DataFrame:
    """commit_no, size, hash of a path at each revision that has it, newest first.

    The operations of each commit that touches the path become one row, and a window over these rows gives its state after each. The other
    commits take the state before them, in blocks of ``block`` commit numbers: each block starts with the state that reaches into it."""
    own = ops.filter(F.col("path") == path)
    reset = F.max(F.when(F.col("kind") != "append", F.col("seq")))
    tail = own.withColumn("_reset", reset.over(Window.partitionBy("commit_no"))).filter("_reset is null or seq >= _reset")
    live = F.col("kind") != "delete"
    parts = tail.withColumn("_live", F.when(live, F.coalesce("content", F.lit(""))))
    touched = parts.groupBy("commit_no").agg(concatenated("_live").alias("_text"), F.count("_live").alias("_n"), F.max("_reset").isNotNull().alias("_resets"))
    by_commit = Window.orderBy("commit_no")
    since = Window.partitionBy("_era").orderBy("commit_no").rowsBetween(Window.unboundedPreceding, 0)
    states = touched.withColumn("_era", F.sum(F.col("_resets").cast("long")).over(by_commit)).withColumn("_next", F.lead("commit_no").over(by_commit))
    text = F.array_join(F.collect_list("_text").over(since), "")
    held = states.withColumn("_text", text).withColumn("_held", F.sum("_n").over(since) > 0)
    state = F.struct(F.col("_held").alias("held"), F.octet_length("_text").cast("long").alias("size"), F.sha2("_text", 256).alias("hash"))
    block_of = lambda c: F.floor(c / block)
    last = commits.agg(F.max("commit_no").alias("_last"))
    until = F.greatest(F.coalesce(F.col("_next") - 1, F.col("_last")), F.col("commit_no"))
    reaching = held.select("commit_no", "_next", state.alias("_state")).crossJoin(F.broadcast(last)).select("commit_no", "_state", F.lit(0).alias("_own"), F.explode(F.sequence(block_of(F.col("commit_no")), block_of(until))).alias("_block"))
    every = commits.select("commit_no", F.lit(None).cast(reaching.schema["_state"].dataType).alias("_state"), F.lit(1).alias("_own"), block_of(F.col("commit_no")).alias("_block"))
    before = Window.partitionBy("_block").orderBy("commit_no", "_own").rowsBetween(Window.unboundedPreceding, 0)
    out = reaching.unionByName(every).withColumn("_state", F.last("_state", True).over(before)).filter((F.col("_own") == 1) & F.col("_state.held")).select("commit_no", "_state.size", "_state.hash")
    return out.orderBy(F.desc("commit_no")).limit(limit) if limit is not None and limit >= 0 else out


def removed_paths(parent: DataFrame, output: DataFrame) -> DataFrame:
    """Paths of the parent view that the output lacks; they become deletes."""
    return parent.select("path").join(output.select("path"), "path", "left_anti")


def commit_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, delta: bytes that a commit adds: a new file's size, or what a changed file has grown by; shrinking adds none."""
    b = before.select("path", F.col("size").alias("_size"), F.col("hash").alias("_hash"))
    grown = F.when(F.col("_hash").isNull(), F.col("size")).when(F.col("_hash") != F.col("hash"), F.greatest(F.col("size") - F.col("_size"), F.lit(0))).otherwise(0)
    return after.join(b, "path", "left").select("path", grown.cast("long").alias("delta"))


def type_conflicts(files: DataFrame) -> DataFrame:
    """Paths that are both a file and a directory of another file."""
    folders = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return files.select("path").distinct().join(folders, "path", "left_semi")


def copied(view: DataFrame, source: str, target: str, overwrite: bool = False) -> DataFrame:
    """Operations that copy a file or a subtree to ``target``."""
    inside = view.filter((F.col("path") == source) | F.col("path").startswith(source + "/"))
    path = F.concat(F.lit(target), F.substring(F.col("path"), len(source) + 1, 1 << 30))
    return inside.withColumn("path", path).withColumn("kind", F.lit("overwrite" if overwrite else "append"))


def changed_headers(files: DataFrame, texts: DataFrame, delimiter: str) -> DataFrame:
    """path, content of the records of files(path, content) whose upload in texts(path, text) has another header than their record 0: the new
    header heads what follows their first delimiter. Records are at <path>/<number>."""
    records = files.select("path", "content", F.regexp_replace("path", "/[^/]*$", "").alias("_of"), F.substring_index("path", "/", -1).alias("_k"))
    first = records.filter("_k = '0'").select("_of", F.substring_index("content", "\n", 1).alias("_first"))
    heads = texts.select(F.col("path").alias("_of"), F.substring_index("text", delimiter, 1).alias("_head"))
    at = F.instr(F.col("content"), delimiter)
    body = F.when(at > 0, F.substring(F.col("content"), at + len(delimiter), F.length("content"))).otherwise(F.col("content"))
    return records.join(heads.join(first, "_of").filter("_first <> _head"), "_of").select("path", F.concat("_head", F.lit(delimiter), body).alias("content"))


def split_records(texts: DataFrame, delimiter: str, header_records: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """texts(path, text) -> path, content of each record, at <path>/<number>. With ``header_records`` the first record heads every other.

    ``existing``(path, n): records that a path has already; numbering goes on after them."""
    if not delimiter:
        raise ValueError("splitting needs a delimiter")
    parts = F.split(F.col("text"), "\\Q" + delimiter + "\\E", -1)
    rows = texts.withColumn("_parts", parts).withColumn("_parts", F.when(F.element_at("_parts", -1) == "", F.slice("_parts", F.lit(1), F.size("_parts") - 1)).otherwise(F.col("_parts")))
    if header_records:
        rows = rows.withColumn("_head", F.concat(F.element_at("_parts", 1), F.lit(delimiter))).withColumn("_parts", F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))))
    else:
        rows = rows.withColumn("_head", F.lit(""))
    if existing is not None:
        rows = rows.join(existing.select(F.col("path").alias("_at"), F.col("n").alias("_from")), F.col("path") == F.col("_at"), "left")
    else:
        rows = rows.withColumn("_from", F.lit(0))
    each = rows.select("path", F.coalesce("_from", F.lit(0)).alias("_from"), "_head", F.posexplode("_parts").alias("k", "rec"))
    return each.select(F.concat_ws("/", "path", (F.col("_from") + F.col("k")).cast("string")).alias("path"), F.concat("_head", "rec").alias("content"))
