"""Input expressions: a small algebra that compiles to lazy datum plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import valid_input_name
from ..operators import datums, globs


class InvalidInput(ValueError):
    pass


@dataclass(frozen=True)
class Input:
    """One of: a repository (repo, glob), or cross, union, join or group of members; or cron."""

    repo: str = ""
    branch: str = "master"
    glob: str = "/*"
    name: str = ""
    join_on: str = ""
    group_by: str = ""
    outer: bool = False
    cross: tuple[Input, ...] = ()
    union: tuple[Input, ...] = ()
    join: tuple[Input, ...] = ()
    group: tuple[Input, ...] = ()
    cron: str = ""
    trigger_bytes: int = 0
    #: The branch that a size trigger watches; ``branch`` is then the one that its snapshots go to.
    trigger_branch: str = ""

    @property
    def kind(self) -> str:
        return next((k for k in ("cross", "union", "join", "group") if getattr(self, k)), "cron" if self.cron else "repo")

    @property
    def members(self) -> tuple[Input, ...]:
        return getattr(self, self.kind) if self.kind in ("cross", "union", "join", "group") else ()

    @property
    def alias(self) -> str:
        return self.name or "".join(c if c.isalnum() and c.isascii() or c == "_" else "_" for c in self.repo)


def derive_triggers(name: str, tree: Input) -> Input:
    """The input with each size trigger on a branch of its own, <name>-<position>: in post-order over crosses and unions."""
    position = 0

    def walk(i: Input) -> Input:
        nonlocal position
        own = {k: tuple(walk(m) for m in getattr(i, k)) for k in ("cross", "union") if getattr(i, k)}
        if i.trigger_bytes > 0:
            own |= {"trigger_branch": i.trigger_branch or i.branch, "branch": f"{name}-{position}"}
        position += 1
        return replace(i, **own)

    return walk(tree)


def sides(i: Input) -> Iterator[Input]:
    """The repositories of an input, in declaration order."""
    if i.kind == "repo" or i.kind == "cron":
        yield i
    for m in i.members:
        yield from sides(m)


def has_union(i: Input) -> bool:
    return i.kind == "union" or any(has_union(m) for m in i.members)


def consumes(i: Input, repo: str, branch: str) -> bool:
    return any(s.repo == repo and s.branch == branch for s in sides(i))


def validate(i: Input, top: bool = True) -> None:
    kinds = [k for k in ("cross", "union", "join", "group") if getattr(i, k)]
    if len(kinds) + bool(i.repo) + bool(i.cron) != 1:
        raise InvalidInput("an input is exactly one of a repository, cron, cross, union, join and group")
    if i.kind == "repo":
        if not valid_input_name(i.alias):
            raise InvalidInput(f"invalid input name {i.alias!r}")
        for selector in (i.join_on, i.group_by):
            if selector and not all(p.isdigit() or not p for p in selector.split("$")):
                raise InvalidInput(f"invalid selector {selector!r}")
        return
    for m in i.members:
        validate(m, False)
    if i.kind in ("join", "group"):
        for m in i.members:
            if m.kind != "repo":
                raise InvalidInput(f"members of a {i.kind} are repositories")
            if i.kind == "join" and not m.join_on:
                raise InvalidInput("a join member needs join_on")
            if i.kind == "group" and not (m.group_by or m.join_on):
                raise InvalidInput("a group member needs group_by")
    if i.kind in ("cross", "join"):
        names = [m.alias for m in i.members if m.kind == "repo"]
        if len(set(names)) < len(names):
            raise InvalidInput("members need distinct namespaces")


Files = Callable[[str, str], DataFrame]


def compile_input(i: Input, files: Files) -> DataFrame:
    """files(repo, branch) -> df(path, hash, size). The result has datum_id, side, path, hash, size and parts (repo, branch and path of
    the files whose contents, in this order, are the file's): one row for each file of each datum."""
    validate(i)
    return _compile(i, files)


def _side(i: Input, files: Files) -> DataFrame:
    f = _files(i, files)
    return globs.scan(f, i.glob).join(f, "path").select(F.col("datum").alias("datum_id"), F.lit(i.alias).alias("side"), *FILE)


FILE = ("path", "hash", "size", "parts")


def _files(i: Input, files: Files) -> DataFrame:
    part = F.struct(F.lit(i.repo).alias("repo"), F.lit(i.branch).alias("branch"), F.col("path"))
    return files(i.repo, i.branch).select("path", "hash", "size", F.array(part).alias("parts"))


def _namespaced(i: Input, df: DataFrame) -> DataFrame:
    """A union's member: a repository's files at their paths, those of a cross at <member>/<path>, of a named union at <name>/<path>."""
    if i.kind == "cross" or i.kind == "union" and i.name:
        return df.withColumn("path", F.concat_ws("/", "side", "path"))
    return df


def _compile(i: Input, files: Files) -> DataFrame:
    if i.kind == "repo":
        return _side(i, files)
    if i.kind == "cross":
        # ids first, on one row per datum; the files come back by an equi-join on the member's id
        parts = [(f"m{k}", _compile(m, files)) for k, m in enumerate(i.members)]
        ids = reduce(lambda a, b: a.crossJoin(b), [p.select(F.col("datum_id").alias(n)).distinct() for n, p in parts])
        label = [m.alias if m.kind == "repo" else n for (n, _), m in zip(parts, i.members, strict=True)]
        ids = ids.withColumn("datum_id", F.concat_ws("+", *[F.concat(F.lit(x + "="), F.col(n)) for (n, _), x in zip(parts, label, strict=True)]))
        return reduce(DataFrame.unionByName, [ids.select("datum_id", n).join(p.withColumnRenamed("datum_id", n), n).drop(n) for n, p in parts])
    if i.kind == "union":
        # one datum for each path; parts in branch order
        every = reduce(DataFrame.unionByName, [_namespaced(m, _compile(m, files)).withColumn("ord", F.lit(k)) for k, m in enumerate(i.members)])
        of = F.array_sort(F.collect_list(F.struct("ord", "datum_id", "hash", F.col("size").cast("long").alias("size"), "parts")))
        merged = every.groupBy("path").agg(of.alias("of"))
        size = F.aggregate("of", F.lit(0).cast("long"), lambda s, p: s + p["size"])
        return merged.select(F.col("path").alias("datum_id"), F.lit(i.name or "union").alias("side"), "path", F.sha2(F.array_join(F.transform("of", lambda p: p["hash"]), ""), 256).alias("hash"), size.alias("size"), F.flatten(F.transform("of", lambda p: p["parts"])).alias("parts"))
    keyed = [(m, datums.keyed(_files(m, files), globs.capture_key(F.col("path"), m.glob, m.join_on or m.group_by))) for m in i.members]
    if i.kind == "group" and not any(m.join_on for m in i.members):
        return reduce(DataFrame.unionByName, [df.select(F.col("key").alias("datum_id"), F.lit(m.alias).alias("side"), *FILE) for m, df in keyed])
    pairs = datums.join([(m.alias, df) for m, df in keyed])
    names = [m.alias for m in i.members]
    ids = F.concat_ws("+", *[F.concat(F.lit(n + "="), F.col(n)) for n in names])
    if i.kind == "group":
        keys = [globs.capture_key(F.col(m.alias), m.glob, m.group_by) for m in i.members]
        pairs = pairs.filter(reduce(lambda a, b: a & b, [keys[0] == k for k in keys[1:]], keys[0].isNotNull()))
        ids = keys[0]
    pairs = pairs.withColumn("datum_id", ids)
    out = [pairs.select("datum_id", F.col(m.alias).alias("path")).distinct().join(df.drop("key"), "path").select("datum_id", F.lit(m.alias).alias("side"), *FILE) for m, df in keyed]
    for m, df in keyed:
        if m.outer and i.kind == "join":
            left = datums.outer_leftovers([(x.alias, d) for x, d in keyed], m.alias)
            out.append(left.select("path").join(df.drop("key"), "path").select(F.concat(F.lit(m.alias + "="), "path").alias("datum_id"), F.lit(m.alias).alias("side"), *FILE))
    return reduce(DataFrame.unionByName, out)


def copy_files(rows: DataFrame) -> DataFrame:
    """The transform of a pipeline that names none: each side's files as they are."""
    return rows.select("datum_id", "path", "content")


@dataclass
class Pipeline:
    name: str
    input: Input
    transform: Callable[[DataFrame], DataFrame] = copy_files
    transform_key: str = ""
    reprocess: bool = False
    version: int = 1
    state: str = "running"
    egress: str = ""
    stats: bool = False
    job_timeout: float | None = None
    history: list[str] = field(default_factory=list)
    stopped_at: tuple[str | None, ...] | None = None
    #: Whether its state is ``standby`` while it has no job.
    standby: bool = False
