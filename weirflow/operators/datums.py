"""The datum algebra: cross, join with outer members, group, union, chunks and digests. All lazy, all on metadata: contents stay out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .view import concatenated

#: Slices of a numbering, about: so many keys are sent with every row as their bounds. Each is the last of so many keys drawn.
SLICES, DRAWN = 256, 16


def cross(sides: list[tuple[str, DataFrame]]) -> DataFrame:
    """sides: (name, df(path)) in order -> one row for each combination: datum_id and a column for each name. The product is the semantics;
    Spark broadcasts a side only where its size is known to be small."""
    parts = [df.select(F.col("path").alias(name)) for name, df in sides]
    joined = reduce(lambda a, b: a.crossJoin(b), parts)
    names = [n for n, _ in sides]
    ids = [F.concat(F.lit(n + "="), F.col(n)) for n in names] if len(names) > 1 else [F.col(names[0])]
    return joined.withColumn("datum_id", F.concat_ws("+", *ids))


def keyed(files: DataFrame, key: Column) -> DataFrame:
    return files.withColumn("key", key).filter("key is not null")


def join(members: list[tuple[str, DataFrame]]) -> DataFrame:
    """members: (name, df(key, path)) -> key and a path of each member, for keys that all members have."""
    parts = [df.select("key", F.col("path").alias(name)) for name, df in members]
    return reduce(lambda a, b: a.join(b, "key"), parts)


def outer_leftovers(members: list[tuple[str, DataFrame]], outer: str) -> DataFrame:
    """key, path of the outer member's files whose key some member lacks; each is a datum of its own."""
    own = dict(members)[outer]
    others = [df.select("key").distinct() for name, df in members if name != outer]
    complete = reduce(lambda a, b: a.join(b, "key", "left_semi"), others, own.select("key").distinct())
    return own.select("key", "path").join(complete, "key", "left_anti")


def group(members: list[tuple[str, DataFrame]]) -> DataFrame:
    """key, n_files, files (of all members, by member and path): a key in any member makes a datum."""
    every = reduce(DataFrame.unionByName, [df.select("key", F.lit(k).alias("member"), "path") for k, (_, df) in enumerate(members)])
    parts = F.array_sort(F.collect_list(F.struct("member", "path")))
    return every.groupBy("key").agg(F.count("*").alias("n_files"), F.array_join(F.transform(parts, lambda p: p["path"]), ",").alias("files"))


def group_of_join(joined: DataFrame, names: list[str], keys: list[Column]) -> DataFrame:
    """Whole pairs by the group key that their members agree on; others go."""
    held = joined.withColumn("group_key", keys[0]).filter(reduce(lambda a, b: a & b, [keys[0] == k for k in keys[1:]], F.lit(True)))
    return held.groupBy("group_key").agg(F.count("*").alias("n_pairs"), (F.count("*") * len(names)).alias("n_files"))


def union(branches: list[DataFrame]) -> DataFrame:
    """branches: df(path, content[, ord]) -> path, content, n_parts: files at one path are put together in branch order."""
    every = reduce(DataFrame.unionByName, [df.select("path", "content", F.lit(k).alias("branch"), (F.col("ord") if "ord" in df.columns else F.lit(0)).cast("long").alias("ord")) for k, df in enumerate(branches)])
    return every.groupBy("path").agg(concatenated("content", ["branch", "ord"]).alias("content"), F.count("*").alias("n_parts"))


def cross_paths(a: tuple[str, DataFrame], b: tuple[str, DataFrame]) -> DataFrame:
    """A cross as a branch of a union: each member's file at <member>/<path>, once for each combination."""
    (na, da), (nb, db) = a, b
    pairs = da.select(F.col("path").alias("pa"), F.col("content").alias("ca")).crossJoin(db.select(F.col("path").alias("pb"), F.col("content").alias("cb")))
    left = pairs.select(F.concat(F.lit(na + "/"), "pa").alias("path"), F.col("ca").alias("content"))
    return left.unionByName(pairs.select(F.concat(F.lit(nb + "/"), "pb").alias("path"), F.col("cb").alias("content")))


def _order_key(order: str | list[str]) -> Column:
    """One comparable column of all columns of ``order``, nulls last as in SQL."""
    return F.struct(*[x for k, c in enumerate([order] if isinstance(order, str) else order) for x in (F.col(c).isNull().alias(f"n{k}"), F.col(c).alias(f"c{k}"))])


def numbered(datums: DataFrame, order: str | list[str], partition: str | None = None) -> DataFrame:
    """Adds row_no, from 0, in the order of ``order`` (nulls last), without one task that holds all rows: each row's slice between bounds, its
    number there, and the running total of the slices' counts. The rows are read more than once, and a sampling range partitioner
    may cut them differently each time; so the bounds come from the keys of least hash, and a row's slice depends on its key alone."""
    if partition:
        return datums.withColumn("_key", _order_key(order)).withColumn("row_no", F.row_number().over(Window.partitionBy(partition).orderBy("_key")).cast("long") - 1).drop("_key")
    rows = datums.withColumn("_key", _order_key(order))
    drawn = rows.select("_key").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all"))))
    drawn = drawn.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) * F.col("_all").cast("double") < float(SLICES * DRAWN << 30))
    bounds = drawn.agg(F.filter(F.array_sort(F.collect_set("_key")), lambda _, k: k % DRAWN == DRAWN - 1).alias("_bounds"))
    # binary search: how many bounds the key has reached
    reached = lambda k: (k <= F.size("_bounds")) & (F.get("_bounds", k - 1) <= F.col("_key"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(SLICES.bit_length() + 1))])
    sliced = rows.crossJoin(F.broadcast(bounds)).withColumn("_slice", F.aggregate(steps, F.lit(0), lambda k, step: F.when(reached(k + step), k + step).otherwise(k))).drop("_bounds")
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    base = counts.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_base"))
    placed = sliced.withColumn("_k", F.row_number().over(Window.partitionBy("_slice").orderBy("_key")))
    return placed.join(F.broadcast(base), "_slice").withColumn("row_no", F.col("_base") + F.col("_k") - 1).drop("_slice", "_key", "_k", "_base")


def assign_workers(datums: DataFrame, parallelism: int, order: str = "datum_id") -> DataFrame:
    """Adds worker: datums in order, dealt in turn to as many workers as asked for, at most one for each datum."""
    workers = max(1, min(parallelism, datums.count()))
    return numbered(datums, order).withColumn("worker", F.pmod(F.col("row_no"), F.lit(workers)))


def chunk_by_number(datums: DataFrame, number: int, order: str = "path") -> DataFrame:
    """Adds chunk: consecutive slices of ceil(n / number) in path order."""
    n = datums.count()
    per = max(1, -(-n // max(1, number)))
    return numbered(datums, order).withColumn("chunk", F.floor(F.col("row_no") / per).cast("long"))


def chunk_by_bytes(datums: DataFrame, limit: int, partition: str) -> DataFrame:
    """partition, chunk, n_files, size: greedily, in path order within each partition, a chunk ends before it would pass ``limit``; a larger file stands alone."""
    files = F.array_sort(F.collect_list(F.struct("path", "size")))
    zero = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<n:bigint,size:bigint>>").alias("done"), F.lit(0).cast("long").alias("n"))
    full = lambda s, f: (s["n"] > 0) & (s["held"] + f["size"] > limit)
    closed = lambda s: F.array_append(s["done"], F.struct(s["n"].alias("n"), s["held"].alias("size")))

    def step(s: Column, f: Column) -> Column:
        return F.struct(
            F.when(full(s, f), f["size"]).otherwise(s["held"] + f["size"]).alias("held"),
            F.when(full(s, f), closed(s)).otherwise(s["done"]).alias("done"),
            F.when(full(s, f), F.lit(1).cast("long")).otherwise(s["n"] + 1).alias("n"),
        )

    folded = datums.groupBy(partition).agg(files.alias("files")).select(partition, F.aggregate("files", zero, step, closed).alias("chunks"))
    return folded.select(partition, F.posexplode("chunks").alias("chunk", "c")).select(partition, F.col("chunk").cast("long").alias("chunk"), F.col("c.n").alias("n_files"), F.col("c.size").alias("size"))


def datum_hash(files: DataFrame, datum: str, name: str) -> DataFrame:
    """datum, hash: sha256 of name, path and content hash of each file in path order, a NUL after each."""
    parts = F.array_sort(F.collect_list(F.struct("path", "hash")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit(name), F.lit("\0"), p["path"], F.lit("\0"), p["hash"], F.lit("\0"))), "")
    return files.groupBy(F.col(datum).alias("datum_id")).agg(F.sha2(text, 256).alias("hash"), F.count("*").alias("n_files"))


def run_datums(datums: DataFrame, transform: Callable, schema: str, tries: int = 1, on_error: Callable | None = None, timeout: float | None = None) -> DataFrame:
    """Runs transform(rows of one datum) -> rows with up to ``tries`` attempts, then ``on_error``. Adds outcome, attempts and reason; the result
    rows of a datum that failed are lost, its outcome isn't. A call is broken off after ``timeout`` seconds, which counts as a failure."""
    import pandas as pd

    def timed(fn: Callable, pdf: pd.DataFrame) -> pd.DataFrame:
        if timeout is None:
            return fn(pdf)
        import signal

        def late(*_: object) -> None:
            raise TimeoutError(f"datum timeout of {timeout} s")

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, timeout)
        try:
            return fn(pdf)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    columns = [c.strip().split()[0] for c in schema.split(",")]

    def attempt(pdf: pd.DataFrame) -> pd.DataFrame:
        datum, reason, out, outcome, attempts = pdf["datum_id"].iloc[0], "", None, "failed", 0
        for attempts in range(1, max(1, tries) + 1):
            try:
                out, outcome = timed(transform, pdf), "success"
                break
            except Exception as error:
                reason = f"datum {datum} failed: {error}"
        if out is None and on_error is not None:
            try:
                out, outcome = timed(on_error, pdf), "recovered"
            except Exception as error:
                reason = f"datum {datum} failed: {error}"
        out = pd.DataFrame(columns=columns) if out is None else out[columns]
        if not len(out):
            out = pd.DataFrame([[None] * len(columns)], columns=columns)
        return out.assign(datum_id=datum, outcome=outcome, attempts=attempts, reason=reason if outcome != "success" else "")

    return datums.groupBy("datum_id").applyInPandas(attempt, f"{schema}, datum_id string, outcome string, attempts int, reason string")
