"""The control plane: finished commits start jobs, jobs run changed datums and commit their outputs, outputs start the next jobs.

Only names and ids are handled on the driver; files and datums are DataFrames throughout."""

from __future__ import annotations

import json
import secrets
import threading
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dag, incremental
from ..operators.datums import numbered
from ..operators.view import commit_delta, concatenated, list_files, removed_paths
from ..sources.egress import egress
from ..sources.store import Store
from .inputs import InvalidInput, Pipeline, compile_input, derive_triggers, has_union, sides, validate

RECORDS = "datum_id string, hash string, outcome string, transform_hash string, datum_ord string, path string, content string"
STATS = "job_id string, datum_id string, state string, hash string, transform_hash string, files array<string>"


@dataclass
class Job:
    job_id: str
    pipeline: str
    inputs: tuple[str, ...]
    state: str = "queued"
    reason: str = ""
    output: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    #: The head of each branch that the input reads, at the moment the job was made; none for a branch without commits.
    heads: dict[tuple[str, str], str | None] = field(default_factory=dict)
    manual: bool = False
    stats: str | None = None

    @property
    def settled(self) -> bool:
        return self.state in ("success", "failure", "killed")


class Engine:
    """One serial event loop: a pairing of heads is decided once, when a commit is finished."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.pipelines: dict[str, Pipeline] = {}
        self.jobs: list[Job] = []
        self.records: dict[str, str] = {}  # pipeline -> folder of the last records
        self._queue: deque[Job] = deque()
        self._draining = False
        self._killed: dict[str, str] = {}  # running job -> why it is to end
        self.ledgers: dict[tuple[str, str], int] = {}  # pipeline, trigger branch -> bytes since the last firing

    def create_pipeline(self, p: Pipeline, update: bool = False) -> None:
        validate(p.input)
        p.input = derive_triggers(p.name, p.input)
        if not p.input.members and p.input.repo == p.name:
            raise InvalidInput("a pipeline can't read its own output")
        old = self.pipelines.get(p.name)
        if old and not update:
            raise InvalidInput(f"pipeline {p.name} exists")
        if old:
            p.version = old.version + 1
            if old.input != p.input:
                self.records.pop(p.name, None)
        elif p.name not in self.store.repos:
            self.store.create_repo(p.name)
        dag.topological([(s.repo, q.name) for q in [*self.pipelines.values(), p] for s in sides(q.input)], [])
        self.pipelines[p.name] = p
        if p.standby and p.state == "running":
            p.state = "standby"
        self._write_spec(p)
        self._schedule(p)
        self._drain()

    def delete_pipeline(self, name: str, force: bool = False) -> None:
        if not force and any(s.repo == name for q in self.pipelines.values() for s in sides(q.input)):
            raise InvalidInput(f"another pipeline reads {name}")
        del self.pipelines[name]
        self.records.pop(name, None)
        self.ledgers = {k: v for k, v in self.ledgers.items() if k[0] != name}
        for j in [j for j in self._queue if j.pipeline == name]:
            self.cancel(j.job_id)

    def delete_repo(self, name: str, force: bool = False) -> None:
        if not force and name in self.pipelines:
            raise InvalidInput(f"{name} is a pipeline's output")
        self.store.delete_repo(name)

    def _busy(self) -> None:
        job = next((j for j in self.jobs if not j.settled), None)
        if job:
            raise InvalidInput(f"job {job.job_id} of {job.pipeline} is {job.state}")

    def collect_garbage(self) -> int:
        """Deletes operations that no commit lists and records that no pipeline uses, while no job is queued or running."""
        self._busy()
        kept = set(self.records.values())
        loose = [f for f in self.store._folders("records/*") if not any(f.endswith(k[len(self.store.root) :]) for k in kept)]
        for folder in loose:
            self.store._drop(folder)
        return len(loose) + self.store.collect_garbage()

    def reset(self, yes: bool = False) -> None:
        """Deletes everything, if confirmed and the catalog can be read."""
        if not yes:
            raise InvalidInput("a reset needs yes")
        self._busy()
        if self.store._folders("catalog") and not self.store.corrupt_catalog().isEmpty():
            raise InvalidInput("the catalog is damaged")
        for folder in ("catalog", "ops", "records"):
            self.store._drop(f"{self.store.root}/{folder}")
        self.store.__init__(self.spark, self.store.root)
        self.__init__(self.store)

    def _write_spec(self, p: Pipeline) -> None:
        """One commit of the repository ``spec`` for each definition."""
        spec = {"name": p.name, "version": p.version, "input": asdict(p.input), "transform": p.transform_key, "reprocess": p.reprocess, "egress": p.egress, "stats": p.stats, "job_timeout": p.job_timeout, "standby": p.standby}
        commit = self.store.start_commit("spec", description=f"pipeline {p.name} v{p.version}")
        self.store.put_file(commit, "spec.json", json.dumps(spec), "overwrite")
        self.store.finish_commit(commit)

    def transaction(self, pipelines: list[Pipeline], expected: dict[str, int] | None = None) -> None:
        """All or none: created in topological order, their jobs run after the last. On an error pipelines, records, repositories and jobs are
        as before. ``expected``: versions that pipelines must still have, 0 for none."""
        for name, version in (expected or {}).items():
            held = self.pipelines.get(name)
            if (held.version if held else 0) != version:
                raise InvalidInput(f"pipeline {name} was changed outside of the transaction")
        order = dag.topological([(s.repo, p.name) for p in pipelines for s in sides(p.input)], [p.name for p in pipelines])
        before = dict(self.pipelines), dict(self.records), dict(self.store.repos), list(self.jobs), deque(self._queue)
        commits, branch_heads = dict(self.store.commits), dict(self.store.heads)
        draining, self._draining = self._draining, True
        try:
            for p in sorted(pipelines, key=lambda p: order.index(p.name)):
                self.create_pipeline(p, update=p.name in self.pipelines)
        except Exception:
            self.pipelines, self.records, self.store.repos, self.jobs, self._queue = before
            self.store.commits, self.store.heads = commits, branch_heads
            self.store._publish()
            raise
        finally:
            self._draining = draining
        self._drain()

    def stop(self, name: str) -> None:
        p = self.pipelines[name]
        p.state, p.stopped_at = "stopped", tuple(self._heads(p).values())

    def start(self, name: str) -> None:
        """Runs one job over the heads, if commits came while it was stopped or no job has seen them."""
        p = self.pipelines[name]
        heads = self._heads(p)
        p.state = "standby" if p.standby else "running"
        if tuple(heads.values()) != p.stopped_at or not any(j.pipeline == name and j.heads == heads for j in self.jobs):
            self._schedule(p)
        p.stopped_at = None
        self._drain()

    def run(self, name: str, commits: list[str] | None = None, job_id: str | None = None) -> Job:
        """A manual job: over the heads, over these commits (one of a branch that the input reads; the heads elsewhere), or over the inputs of
        a job. Its output starts no other job."""
        p = self.pipelines[name]
        heads = self._heads(p)
        if job_id is not None:
            heads = dict(self.job(job_id).heads)
        chosen: set[tuple[str, str]] = set()
        for c in commits or []:
            if c not in self.store.commits:
                raise InvalidInput(f"no commit {c}")
            at = self.store.commits[c].repo, self.store.commits[c].branch
            if at not in heads:
                raise InvalidInput(f"{name} doesn't read {at[0]}@{at[1]}")
            if at in chosen:
                raise InvalidInput(f"two commits of {at[0]}@{at[1]}")
            chosen.add(at)
            heads[at] = c
        job = Job(secrets.token_hex(8), name, tuple(dict.fromkeys(h for h in heads.values() if h)), heads=heads, manual=True)
        self.jobs.append(job)
        self._queue.append(job)
        self._drain()
        return job

    def job(self, job_id: str) -> Job:
        """By its id or its output commit."""
        found = next((j for j in self.jobs if job_id in (j.job_id, j.output)), None)
        if found is None:
            raise InvalidInput(f"no job {job_id}")
        return found

    def cancel(self, job_id: str) -> None:
        """A queued job is killed at once, a running one at its next Spark task; a settled one stays as it is."""
        job = self.job(job_id)
        if job.state == "queued":
            self._queue = deque(j for j in self._queue if j is not job)
            job.state, job.reason = "killed", "cancelled"
        elif job.state == "running":
            self._kill(job, "cancelled")

    def delete_job(self, job_id: str) -> None:
        job = self.job(job_id)
        if job.state == "running":
            raise InvalidInput(f"job {job_id} is running; cancel it first")
        self.cancel(job_id)
        self.jobs.remove(job)

    def _kill(self, job: Job, reason: str) -> None:
        self._killed.setdefault(job.job_id, reason)
        self.spark.sparkContext.cancelJobGroup(job.job_id)

    def inspect_datum(self, job_id: str, datum_id: str) -> dict:
        """The record of a datum in the stats commit of its job."""
        job = self.job(job_id)
        if job.stats is None:
            raise InvalidInput("the pipeline keeps no stats")
        rows = self.store.view(job.stats).select(F.from_json("content", STATS).alias("r")).filter(F.col("r.datum_id") == datum_id).take(1)
        if not rows:
            raise InvalidInput(f"no datum {datum_id}")
        return rows[0]["r"].asDict(recursive=True)

    def finish_commit(self, commit: str, empty: bool = False) -> None:
        self.store.finish_commit(commit, empty=empty)
        self._finished(commit)
        self._drain()

    def _finished(self, commit: str) -> None:
        c = self.store.commits[commit]
        for p in self.pipelines.values():
            if any((s.repo, s.branch) == (c.repo, c.branch) for s in sides(p.input)):
                self._schedule(p)
        for p in list(self.pipelines.values()):
            for s in sides(p.input):
                if s.trigger_bytes > 0 and (s.repo, s.trigger_branch) == (c.repo, c.branch):
                    self._trigger((p.name, s.branch), s.trigger_bytes, commit)

    def _trigger(self, ledger: tuple[str, str], threshold: int, commit: str) -> None:
        """Adds a commit's new bytes to the ledger. For each threshold in it one commit on the trigger's branch overwrites the files of the
        whole current view; deleted ones stay there."""
        c = self.store.commits[commit]
        files = lambda at: list_files(self.store.view(at))
        before = files(c.parent_id) if c.parent_id else files(commit).limit(0)
        added = commit_delta(before, files(commit)).agg(F.coalesce(F.sum("delta"), F.lit(0))).first()[0]
        fires, self.ledgers[ledger] = divmod(self.ledgers.get(ledger, 0) + added, threshold)
        for _ in range(fires):
            snapshot = self.store.start_commit(c.repo, ledger[1])
            self.store.put(snapshot, self.store.view(commit).select("path", "content"), "overwrite")
            self.store.finish_commit(snapshot)
            self._finished(snapshot)

    def _heads(self, p: Pipeline) -> dict[tuple[str, str], str | None]:
        return {(i.repo, i.branch): self.store.heads.get((i.repo, i.branch)) for i in sides(p.input)}

    def _schedule(self, p: Pipeline) -> None:
        """A job over the current heads, unless it is stopped, they disagree on a source, or the same job exists."""
        heads = self._heads(p)
        inputs = tuple(dict.fromkeys(h for h in heads.values() if h))
        if not inputs or p.state == "stopped" or not self.consistent(inputs):
            return
        if any(j.pipeline == p.name and j.heads == heads and j.state in ("queued", "running") for j in self.jobs):
            return
        self.jobs.append(job := Job(secrets.token_hex(8), p.name, inputs, heads=heads))
        self._queue.append(job)

    def consistent(self, heads: tuple[str, ...]) -> bool:
        """Whether no source branch is reached at two revisions."""
        seen: dict[tuple[str, str], str] = {}
        for h in heads:
            c = self.store.commits[h]
            for leaf in [x for x in c.provenance if x in self.store.commits and not self.store.commits[x].provenance] or [h]:
                s = self.store.commits[leaf]
                if seen.setdefault((s.repo, s.branch), leaf) != leaf:
                    return False
        return True

    def _drain(self) -> None:
        if self._draining:
            return
        self._draining = True
        try:
            while self._queue:
                job = self._queue.popleft()
                p = self.pipelines[job.pipeline]
                if p.state == "standby":
                    p.state = "running"
                self._run(job)
                if p.standby and p.state == "running" and not any(j.pipeline == p.name for j in self._queue):
                    p.state = "standby"
        finally:
            self._draining = False

    def _settle_empty(self, job: Job, state: str, reason: str, provenance: list[str]) -> None:
        """A job that came to nothing: an empty output commit."""
        job.state, job.reason = state, reason[-4000:]
        job.output = self.store.start_commit(job.pipeline, provenance=provenance)
        self.store.finish_commit(job.output, empty=True)
        if not job.manual:
            self._finished(job.output)

    def _contents(self, job: Job, todo: DataFrame, merged: bool) -> DataFrame:
        """todo with the content of each file, as the job's commits have it; a file of several parts is their concatenation."""
        held = [self.store.view(c).select(F.lit(repo).alias("_repo"), F.lit(branch).alias("_branch"), F.col("path").alias("_path"), "content") for (repo, branch), c in job.heads.items() if c]
        if not held:
            return todo.drop("parts").withColumn("content", F.lit(None).cast("string")).limit(0)
        of = [F.col("_part.repo") == F.col("_repo"), F.col("_part.branch") == F.col("_branch"), F.col("_part.path") == F.col("_path")]
        rows = todo.select("*", F.posexplode("parts").alias("_pos", "_part")).drop("parts").join(reduce(DataFrame.unionByName, held), of)
        if not merged:
            return rows.drop("_pos", "_part", "_repo", "_branch", "_path")
        return rows.groupBy(*[c for c in todo.columns if c != "parts"]).agg(concatenated("content", "_pos").alias("content"))

    def _run(self, job: Job) -> None:
        p = self.pipelines[job.pipeline]
        failed = [j for j in self.jobs if j.output in job.inputs and j.state == "failure"]
        provenance = list(dict.fromkeys(x for h in job.inputs for x in (h, *self.store.commits[h].provenance)))
        if failed:
            self._settle_empty(job, "failure", "an input's job failed", provenance)
            return
        job.state = "running"
        context = self.spark.sparkContext
        context.setJobGroup(job.job_id, f"job of {p.name}", interruptOnCancel=True)
        timer = threading.Timer(p.job_timeout, self._kill, (job, f"job timeout of {p.job_timeout} s")) if p.job_timeout else None
        if timer:
            timer.start()
        try:
            records, last_key = self._execute(job, p)
        except Exception as error:
            killed = self._killed.pop(job.job_id, None)
            self._settle_empty(job, "killed" if killed else "failure", killed or str(error), provenance)
            return
        finally:
            if timer:
                timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if killed := self._killed.pop(job.job_id, None):
            self._settle_empty(job, "killed", killed, provenance)
            return
        self.records[p.name] = last_key
        states = records.select("datum_id", F.when(F.col("fresh"), F.col("outcome")).otherwise("skipped").alias("state")).distinct().withColumn("job_id", F.lit(job.job_id))
        got = incremental.job_counters(states).first()
        job.counts = {k: got[k] for k in ("processed", "recovered", "failed", "skipped")} if got else dict.fromkeys(("processed", "recovered", "failed", "skipped"), 0)
        if got is None:  # no datums: success without a commit
            job.state = "success"
            return
        good = records.filter("outcome <> 'failed' and path is not null")
        merged = incremental.merge_outputs(good.filter("fresh"), good.filter(~F.col("fresh")), p.transform_key)
        job.output = self.store.start_commit(p.name, provenance=provenance)
        parent = self.store.heads.get((p.name, "master"))
        self.store.put(job.output, merged.select("path", "content"), "overwrite")
        if parent:
            self.store.put(job.output, removed_paths(self.store.view(parent), merged), "delete")
        self.store.finish_commit(job.output)
        job.state = "failure" if job.counts["failed"] else "success"
        if p.stats:
            self._publish_stats(job, records, provenance)
        if p.egress:
            try:
                egress(self.store.view(job.output), p.egress)
            except Exception as error:
                job.state, job.reason = "failure", str(error)
        if not job.manual:
            self._finished(job.output)

    def _execute(self, job: Job, p: Pipeline) -> tuple[DataFrame, str]:
        """Runs the datums that changed; the records of all of them, and the folder that holds them."""

        def files(repo: str, branch: str) -> DataFrame:
            head = job.heads.get((repo, branch))
            return list_files(self.store.view(head)) if head else self.spark.createDataFrame([], "path string, size long, hash string")

        datums = compile_input(p.input, files)
        hashed = datums.groupBy("datum_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "path", "hash"))), lambda f: F.concat(f["side"], F.lit("\0"), f["path"], F.lit("\0"), f["hash"], F.lit("\0"))), ""), 256).alias("hash"))
        last = self.spark.read.schema(RECORDS).parquet(self.records[p.name]) if p.name in self.records else self.spark.createDataFrame([], RECORDS)
        tested = incremental.skip_test(hashed, last, p.reprocess)
        todo = datums.join(tested.filter(~F.col("skipped")).select("datum_id", "hash").withColumnRenamed("hash", "datum_hash"), "datum_id")
        # the transform's rows: datum_id, path, content and, where it has them, outcome
        made = p.transform(self._contents(job, todo, has_union(p.input)))
        if "outcome" not in made.columns:
            made = made.withColumn("outcome", F.lit("success"))
        fresh = tested.filter(~F.col("skipped")).select("datum_id", "hash").join(made.select("datum_id", "path", "content", "outcome"), "datum_id", "left")
        fresh = fresh.select("datum_id", "hash", F.coalesce("outcome", F.lit("success")).alias("outcome"), F.lit(p.transform_key).alias("transform_hash"), F.col("datum_id").alias("datum_ord"), "path", "content")
        kept = last.join(tested.filter("skipped").select("datum_id"), "datum_id", "left_semi").select(*fresh.columns)
        folder = f"{self.store.root}/records/{p.name}/{uuid.uuid4().hex}"
        fresh.withColumn("fresh", F.lit(True)).unionByName(kept.withColumn("fresh", F.lit(False))).write.parquet(folder)
        return self.spark.read.schema(RECORDS + ", fresh boolean").parquet(folder), folder

    def _publish_stats(self, job: Job, records: DataFrame, provenance: list[str]) -> None:
        """A commit on the output's branch ``stats``: a file for each datum, numbered in id order, with its record as JSON."""
        state = F.when(F.first("fresh"), F.first("outcome")).otherwise("skipped")
        files = F.filter(F.array_sort(F.collect_list("path")), lambda x: x.isNotNull())
        each = records.groupBy("datum_id").agg(state.alias("state"), F.first("hash").alias("hash"), F.first("transform_hash").alias("transform_hash"), files.alias("files"))
        rows = numbered(each, "datum_id").withColumn("job_id", F.lit(job.job_id))
        text = F.to_json(F.struct("job_id", "datum_id", "state", "hash", "transform_hash", "files"))
        job.stats = self.store.start_commit(job.pipeline, "stats", provenance=provenance)
        self.store.put(job.stats, rows.select(F.format_string("%06d", "row_no").alias("path"), text.alias("content")), "overwrite")
        self.store.finish_commit(job.stats)

    def flush(self, commits: list[str]) -> list[Job]:
        """The last job of each pipeline downstream of all these commits."""
        reached = [{j.job_id: j for j in self.jobs if any(c == i or c in self.store.commits[i].provenance for i in j.inputs if i in self.store.commits)} for c in commits]
        shared = set.intersection(*[set(r) for r in reached]) if reached else set()
        return list({j.pipeline: j for j in self.jobs if j.job_id in shared}.values())


def per_datum(fn: Callable, schema: str = "path string, content string", tries: int = 1, on_error: Callable | None = None, timeout: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """A transform of a Python function over one datum's rows, with attempts, an error handler and seconds that an attempt may take."""
    from ..operators.datums import run_datums

    return lambda rows: run_datums(rows, fn, schema, tries, on_error, timeout).select("datum_id", "path", "content", "outcome")
