"""Provenance and scheduling queries over commits and jobs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_heads(commits: DataFrame, sides: list[str], order: str = "seq") -> DataFrame:
    """commits(pipeline, side, commit_id, seq) -> for each commit the head of every side at that moment, null before its first."""
    w = Window.partitionBy("pipeline").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return commits.select("pipeline", order, *[F.last(F.when(F.col("side") == s, F.col("commit_id")), ignorenulls=True).over(w).alias(f"head_{s}") for s in sides])


def consistent_pairings(leaves: DataFrame) -> DataFrame:
    """leaves(pairing, source, leaf) -> pairings in which no source appears at two revisions."""
    worst = leaves.groupBy("pairing", "source").agg(F.count_distinct("leaf").alias("n")).groupBy("pairing").agg(F.max("n").alias("worst"))
    return worst.filter("worst = 1").select("pairing")


def same_inputs(jobs: DataFrame, states: Iterable[str] | None = None) -> DataFrame:
    """pipeline, inputs, n of input sets that several jobs of a pipeline have; of those in ``states`` only, if given."""
    held = jobs.filter(F.col("state").isin(*states)) if states else jobs
    return held.groupBy("pipeline", F.array_join(F.array_sort(F.array_distinct("inputs")), ",").alias("inputs")).agg(F.count("*").alias("n")).filter("n > 1")


def closure(edges: DataFrame, seeds: DataFrame, checkpoint=None) -> DataFrame:
    """edges(src, dst), seeds(node) -> seed, node: all that can be reached, the seeds themselves left out. One join for each level; nodes are visited
    once for a seed, so diamonds don't multiply and cycles end. ``checkpoint`` cuts the lineage of a level."""
    keep = checkpoint or (lambda df: df.checkpoint())
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct()
    seen = frontier
    while True:
        frontier = keep(frontier.join(edges, frontier["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = keep(seen.unionByName(frontier))
    return seen.filter("seed <> node")


def layered_closure(stages: list[DataFrame]) -> DataFrame:
    """stages: edges(src, dst) of a shallow chain of stages -> seed, node without iteration, for graphs whose depth is known."""
    out = [s.select(F.col("src").alias("seed"), F.col("dst").alias("node")) for s in stages]
    reach = out[0]
    every = [reach]
    for stage in stages[1:]:
        every.append(stage.select(F.col("src").alias("seed"), F.col("dst").alias("node")))
    for first in range(len(stages)):
        step = stages[first].select(F.col("src").alias("seed"), F.col("dst").alias("node"))
        for stage in stages[first + 1 :]:
            step = step.join(stage, step["node"] == stage["src"]).select("seed", F.col("dst").alias("node"))
            every.append(step)
    return reduce(DataFrame.unionByName, every).distinct()


def flush_intersection(reach: DataFrame, seeds: list[str]) -> DataFrame:
    """Nodes downstream of every seed."""
    return reach.filter(F.col("seed").isin(*seeds)).groupBy("node").agg(F.count_distinct("seed").alias("n")).filter(F.col("n") == len(set(seeds))).select("node")


def subvenants(provenance: DataFrame, commit: str) -> DataFrame:
    """provenance(commit_id, provenance) -> commits that have the commit in their provenance."""
    return provenance.filter(F.array_contains("provenance", commit)).select("commit_id")


def survivors(commits: DataFrame, doomed: DataFrame) -> DataFrame:
    """commits(repo, commit_no), doomed(repo, commit_no) -> what is left, each with its nearest surviving parent."""
    left = commits.join(doomed, ["repo", "commit_no"], "left_anti")
    return left.withColumn("parent_no", F.lag("commit_no").over(Window.partitionBy("repo").orderBy("commit_no")))


def backlog(chain: DataFrame, watermark: str) -> DataFrame:
    """chain(repo, commit_no, ...) after the watermark column, oldest first by commit_no."""
    return chain.filter(F.col("commit_no") > F.col(watermark))


def latest_per(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def topological(edges: list[tuple[str, str]], nodes: Iterable[str]) -> list[str]:
    """Kahn's order, ready nodes by name; an error for a cycle. For the few nodes of a set of pipelines."""
    import heapq

    nodes = set(nodes) | {x for e in edges for x in e}
    missing = {n: sum(1 for _, b in set(edges) if b == n) for n in nodes}
    ready = [n for n, k in missing.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for a, b in set(edges):
            if a == n:
                missing[b] -= 1
                if not missing[b]:
                    heapq.heappush(ready, b)
    if len(out) < len(nodes):
        raise ValueError(f"cycle among {sorted(nodes - set(out))}")
    return out
