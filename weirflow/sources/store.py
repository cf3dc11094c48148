"""The versioned store: repositories of immutable commits, as append-only Parquet tables under one folder.

The catalog of branches and commits is small and lives on the driver, written as a snapshot with each change; file operations are Parquet
rows, one folder for each batch, listed by the commit that they belong to. A commit's operations appear when its row does."""

from __future__ import annotations

import ipaddress
import json
import secrets
import socket
import time
import urllib.parse
import urllib.request
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import valid_name, valid_path
from ..operators import catalog, view
from ..schemas import FILE_OPS


class StoreError(ValueError):
    pass


@dataclass
class Commit:
    commit_id: str
    repo: str
    branch: str
    parent_id: str | None
    description: str = ""
    finished: bool = False
    empty: bool = False
    provenance: list[str] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)
    n_ops: int = 0
    created: float = 0.0


def fetched(url: str, most: int) -> bytes:
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise StoreError(f"not an http or https address: {url!r}")
    port = parts.port or (443 if parts.scheme == "https" else 80)
    for *_, address in socket.getaddrinfo(parts.hostname, port, type=socket.SOCK_STREAM):
        ip = ipaddress.ip_address(address[0].split("%")[0])
        if ip.is_link_local or ip.is_multicast or ip.is_unspecified:
            raise StoreError(f"address {ip} isn't allowed")

    class Refuse(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            return None

    try:
        with urllib.request.build_opener(Refuse, urllib.request.ProxyHandler({})).open(url, timeout=60) as answer:
            body = answer.read(most + 1)
    except OSError as error:
        raise StoreError(f"{url}: {error}") from error
    if len(body) > most:
        raise StoreError(f"{url}: over {most} bytes")
    return body


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits: dict[str, Commit] = {}
        self.heads: dict[tuple[str, str], str] = {}
        self.repos: dict[str, str] = {}  # name -> primary branch
        self.tags: list[tuple[str, int, str | None]] = []
        self.secrets: dict[str, dict[str, str]] = {}

    # repositories and branches

    def create_repo(self, name: str) -> None:
        if not valid_name(name):
            raise StoreError(f"invalid name {name!r}")
        if name in self.repos:
            raise StoreError(f"repository {name} exists")
        self.repos[name] = ""

    def delete_repo(self, name: str) -> None:
        if name == "spec" or name not in self.repos:
            raise StoreError(f"repository {name} can't be deleted")
        del self.repos[name]
        self.heads = {k: v for k, v in self.heads.items() if k[0] != name}

    def create_branch(self, repo: str, branch: str, head: str) -> None:
        if self.commits[head].repo != repo:
            raise StoreError("the head is in another repository")
        self.heads[repo, branch] = head

    def delete_branch(self, repo: str, branch: str) -> None:
        if self.repos.get(repo) == branch:
            raise StoreError("the default branch can't be deleted")
        self.heads.pop((repo, branch))

    def branches(self, repo: str) -> list[str]:
        return sorted(b for r, b in self.heads if r == repo)

    # commits

    def start_commit(self, repo: str, branch: str = "master", description: str = "", provenance: list[str] | None = None) -> str:
        if repo not in self.repos:
            self.create_repo(repo)
        c = Commit(secrets.token_hex(8), repo, branch, self.heads.get((repo, branch)), description, provenance=list(provenance or []), created=time.time())
        self.commits[c.commit_id] = c
        return c.commit_id

    def _open(self, commit: str) -> Commit:
        c = self.commits.get(commit)
        if c is None:
            raise StoreError(f"no commit {commit}")
        if c.finished:
            raise StoreError(f"commit {commit} is finished")
        return c

    def put(self, commit: str, rows: DataFrame, kind: str = "append") -> None:
        """rows(path, content[, ord]): operations of one kind, in the order of ``ord``, after all that the commit has."""
        c = self._open(commit)
        seq = F.row_number().over(Window.orderBy("ord", "path")) if "ord" in rows.columns else F.lit(1)
        content = F.col("content") if "content" in rows.columns else F.lit(None).cast("string")
        out = rows.select(F.lit(c.repo).alias("repo"), F.lit(commit).alias("commit_id"), (F.lit(c.n_ops) + seq).cast("int").alias("op_idx"), "path", F.lit(kind).alias("kind"), F.sha2(content, 256).alias("sha"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))
        batch = f"{self.root}/ops/{c.repo}/{uuid.uuid4().hex}"
        out.write.parquet(batch)
        c.batches.append(batch)
        c.n_ops += 1 + (rows.count() if "ord" in rows.columns else 0)

    def put_file(self, commit: str, path: str, content: str, kind: str = "append") -> None:
        if not valid_path(path):
            raise StoreError(f"invalid path {path!r}")
        self.put(commit, self.spark.createDataFrame([(path, content)], "path string, content string"), kind)

    def delete_file(self, commit: str, path: str) -> None:
        self.put(commit, self.spark.createDataFrame([(path,)], "path string"), "delete")

    def put_split(self, commit: str, path: str, text: str, delimiter: str, header: bool = False) -> None:
        """Records go on after those that the path has. Under another header those are rewritten in place, and the upload only adds the records
        beyond their number."""
        if not delimiter or header and delimiter not in text:
            raise StoreError("a split needs a delimiter, one with a header needs it in the text")
        held = self.view(commit).filter(F.col("path").startswith(path + "/"))
        n = held.count()
        texts = self.spark.createDataFrame([(path, text)], "path string, text string")
        rewritten = view.changed_headers(held, texts, delimiter)
        if header and n and not rewritten.isEmpty():
            self.put(commit, rewritten, "overwrite")
            added = view.split_records(texts, delimiter, header).filter(F.substring_index("path", "/", -1).cast("long") >= n)
        else:
            added = view.split_records(texts, delimiter, header, self.spark.createDataFrame([(path, n)], "path string, n int"))
        self.put(commit, added, "overwrite")

    def put_url(self, commit: str, path: str, url: str, most: int = 1 << 30) -> None:
        """The body that http or https gives at ``url``, without following redirects, from no link-local, multicast or unspecified address."""
        self.put_file(commit, path, fetched(url, most).decode())

    def copy(self, commit: str, target: str, source_commit: str, source: str, overwrite: bool = False) -> None:
        rows = view.copied(self.view(source_commit).select("path", "content"), source, target, overwrite)
        if rows.isEmpty():
            raise StoreError(f"{source} not found")
        if not overwrite and not self.view(commit).join(rows.select("path"), "path", "left_semi").isEmpty():
            raise StoreError(f"{target} exists")
        self.put(commit, rows.select("path", "content"), "overwrite" if overwrite else "append")

    def chain(self, commit: str) -> list[Commit]:
        """Oldest first, from the first that a view takes into account: an empty commit hides itself and all before it."""
        out, at = [], self.commits.get(commit)
        while at is not None and not at.empty:
            out.append(at)
            at = self.commits.get(at.parent_id) if at.parent_id else None
        return out[::-1]

    def ops(self, commit: str) -> DataFrame:
        chain = self.chain(commit)
        batches = [b for c in chain for b in c.batches]
        if not batches:
            return self.spark.createDataFrame([], FILE_OPS + ", seq long")
        depth = self.spark.createDataFrame([(c.commit_id, k) for k, c in enumerate(chain)], "commit_id string, depth long")
        return self.spark.read.schema(FILE_OPS).parquet(*batches).join(F.broadcast(depth), "commit_id").withColumn("seq", F.col("depth") * (1 << 31) + F.col("op_idx"))

    def view(self, commit: str) -> DataFrame:
        return view.resolve_view(self.ops(commit))

    def files(self, repo: str, branch: str = "master") -> DataFrame:
        head = self.heads.get((repo, branch))
        return view.list_files(self.view(head)) if head else self.spark.createDataFrame([], "path string, size long, hash string")

    def get_file(self, commit: str, path: str) -> str:
        row = view.resolve_view(self.ops(commit).filter(F.col("path") == path)).first()
        if row is None:
            raise FileNotFoundError(path)
        return row["content"]

    def finish_commit(self, commit: str, description: str | None = None, empty: bool = False) -> str:
        c = self._open(commit)
        if not empty and not view.type_conflicts(self.view(commit).select("path")).isEmpty():
            raise StoreError("a path is both a file and a directory")
        head = self.heads.get((c.repo, c.branch))
        if head != c.parent_id:  # the branch has moved on: stay linear
            c.parent_id = head
        c.description, c.finished, c.empty = c.description if description is None else description, True, empty
        self.heads[c.repo, c.branch] = commit
        if not self.repos[c.repo]:
            self.repos[c.repo] = c.branch
        self._publish()
        return commit

    def _publish(self) -> None:
        """A snapshot of the catalog. The last two stay, so one that was cut off leaves the one before it."""
        state = {"commits": [asdict(c) for c in self.commits.values()], "heads": [[*k, v] for k, v in self.heads.items()], "repos": self.repos, "tags": self.tags, "secrets": self.secrets}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.root}/catalog/{time.time_ns():020d}")
        for old in self._folders("catalog")[:-2]:
            self._drop(old)

    def _folders(self, pattern: str) -> list[str]:
        """Paths below the root that match, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}/*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(s.getPath().toString() for s in found or [])

    def _drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def collect_garbage(self, pattern: str = "ops/*") -> int:
        """Deletes the operations that no commit lists, but for those whose content a tag names; the number of folders."""
        used = {b.rsplit("/", 1)[1] for c in self.commits.values() for b in c.batches}
        loose = [f for f in self._folders(pattern) if f.rsplit("/", 1)[1] not in used]
        if loose and self.tags:
            rows = self.spark.read.schema(FILE_OPS).parquet(*loose).select("sha", F.input_file_name().alias("file"))
            tagged = rows.join(self.tag_table().select(F.col("ref").alias("sha")), "sha", "left_semi").select(F.element_at(F.split("file", "/"), -2).alias("folder")).distinct()
            kept = {r["folder"] for r in tagged.collect()}  # one name for each folder at most
            loose = [f for f in loose if f.rsplit("/", 1)[1] not in kept]
        for folder in loose:
            self._drop(folder)
        return len(loose)

    def corrupt_catalog(self) -> DataFrame:
        """id, json of the snapshots that can't be read."""
        lines = self.spark.read.text(f"{self.root}/catalog/*").select(F.input_file_name().alias("id"), F.col("value").alias("json"))
        return catalog.corrupt_records(lines, "commits array<struct<commit_id:string,repo:string>>, repos map<string,string>")

    def materialize(self, commit: str, target: str, prefix: str = "") -> None:
        """path, content of the files below ``prefix``, as Parquet."""
        self.view(commit).filter(F.col("path").startswith(prefix)).select("path", "content").write.mode("overwrite").parquet(target)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Store:
        from pyspark.errors import AnalysisException

        store = cls(spark, root)
        try:
            rows = spark.read.text(f"{store.root}/catalog/*").select("value", F.input_file_name().alias("f")).orderBy(F.desc("f")).first()
        except AnalysisException:
            return store
        state = json.loads(rows["value"])
        store.commits = {c["commit_id"]: Commit(**c) for c in state["commits"]}
        store.heads = {(r, b): h for r, b, h in state["heads"]}
        store.repos, store.tags, store.secrets = state["repos"], [tuple(t) for t in state["tags"]], state.get("secrets", {})
        return store

    def repo_size(self, repo: str) -> int:
        return self.files(repo, self.repos[repo] or "master").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def history(self, commit: str) -> list[str]:
        out, at = [], self.commits.get(commit)
        while at is not None:
            out.append(at.commit_id)
            at = self.commits.get(at.parent_id) if at.parent_id else None
        return out[::-1]

    def backlog(self, head: str, watermark: str | None) -> list[str]:
        ids = self.history(head)
        return ids[ids.index(watermark) + 1 :] if watermark in ids else ids

    # tags, secrets, garbage

    def put_tag(self, name: str, ref: str | None) -> None:
        self.tags.append((name, len(self.tags), ref))

    def tag_table(self) -> DataFrame:
        return catalog.latest_tags(self.spark.createDataFrame(self.tags, "name string, seq long, ref string"))

    def put_secret(self, name: str, data: dict[str, str]) -> None:
        if not valid_name(name):
            raise StoreError(f"invalid name {name!r}")
        self.secrets[name] = dict(data)
        self._publish()

    def secret(self, name: str) -> dict[str, str]:
        if name not in self.secrets:
            raise StoreError(f"no secret {name}")
        return dict(self.secrets[name])

    def delete_secret(self, name: str) -> None:
        self.secret(name)
        del self.secrets[name]
        self._publish()

    def list_secrets(self) -> list[str]:
        return sorted(self.secrets)

    def delete_commit(self, commit: str, jobs: list[tuple[list[str], str]] = ()) -> set[str]:
        """Removes a commit and all that jobs (inputs, output) derived from it; parents are relinked to the nearest survivor."""
        doomed, grown = {commit}, True
        while grown:
            more = {out for inputs, out in jobs if doomed & set(inputs)} - doomed
            grown, doomed = bool(more), doomed | more

        def nearest(at: str | None) -> str | None:
            while at in doomed:
                at = self.commits[at].parent_id
            return at

        self.heads = {k: h for k, v in self.heads.items() if (h := nearest(v))}
        for c in self.commits.values():
            c.parent_id = nearest(c.parent_id)
        for d in doomed:
            self.commits.pop(d, None)
        self._publish()
        return doomed

    def backup(self, target: str) -> None:
        """A copy of the live operations of every head and the catalog."""
        self._publish()
        for (repo, branch), head in sorted(self.heads.items()):
            self.ops(head).write.mode("overwrite").parquet(f"{target}/ops/{repo}/{branch}")
        self.spark.read.text(f"{self.root}/catalog/*").write.mode("overwrite").text(f"{target}/catalog")
