"""Sharding: size-tiered compaction of immutable shards under a versioned manifest. DataFrame operations only.

A store is a folder with ``data/`` (a folder of Parquet files for each shard, never changed) and ``manifest/``, one JSON file for each
version that lists the shards in it. An arrival is written as a shard and committed; when a size tier holds enough shards, they are
merged into files of the target size and replaced by the next version. A version file appears by one rename that
fails if it exists, so readers see all of a change or none of it, a writer that lost its race retries, and one that dies leaves
only files that no version lists, for ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch_path

#: Shards of one tier that are merged at once; each tier holds shards FAN_IN times as large as the last.
FAN_IN = 4
TARGET_BYTES, LEAST_BYTES = 128 << 20, 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


def tier_of(size: int, least: int = LEAST_BYTES, fan_in: int = FAN_IN) -> int:
    """0 for shards of up to ``least`` bytes, one more for each factor of ``fan_in``."""
    tier, bound = 0, least
    while size > bound:
        tier, bound = tier + 1, bound * fan_in
    return tier


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.least_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, least_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _shard(self, path: str) -> Shard:
        return Shard(path, self._fs.getContentSummary(self._path(f"{self.root}/{path}")).getLength())

    def version(self) -> int:
        """The last committed version; 0 is the empty store."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, after: int, shards: list[Shard]) -> int:
        name = f"{self.root}/manifest/v{after + 1:010d}.json"
        draft = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": after + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(name), options)
        except Exception as error:
            self._fs.delete(draft, False)
            if "AlreadyExists" in str(error):
                raise Conflict(name) from error
            raise
        return after + 1

    def _change(self, change) -> int:
        """Commits change(shards), again on the newest version if another writer was first."""
        while True:
            at = self.version()
            try:
                return self._commit(at, change(self.shards(at)))
            except Conflict:
                continue

    def append(self, rows: DataFrame) -> int:
        """Writes an arrival as one shard and commits it. An empty arrival is a shard too, so its schema is kept."""
        path = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        new = self._shard(path)
        return self._change(lambda shards: [*shards, new])

    def append_arrivals(self, rows: DataFrame, arrival: str) -> int:
        """Writes each value of the column ``arrival`` as a shard of its own, in one pass, and commits them together. The column isn't stored."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy(arrival).parquet(f"{self.root}/{folder}")
        parts = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.isDirectory()]
        new = [self._shard(f"{folder}/{p}") for p in sorted(parts)]
        return self._change(lambda shards: [*shards, *new])

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The merges that are due: ``fan_in`` or more shards of a tier, oldest first."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            tiers.setdefault(tier_of(s.bytes, self.least_bytes, self.fan_in), []).append(s)
        return [own[k : k + self.fan_in] for _, own in sorted(tiers.items()) for k in range(0, len(own) - self.fan_in + 1, self.fan_in)]

    def compact(self) -> int:
        """Merges until no tier is full; returns the version. Rows don't change, and no shuffle is needed."""
        while due := self.plan(self.shards()):
            for old in due:
                path, total = f"data/{uuid.uuid4().hex}", sum(s.bytes for s in old)
                merged = self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in old])
                merged.coalesce(max(1, -(-total // self.target_bytes))).write.parquet(f"{self.root}/{path}")
                new, gone = self._shard(path), {s.path for s in old}

                def swap(shards: list[Shard], gone=gone, new=new) -> list[Shard]:
                    if not gone <= {s.path for s in shards}:
                        raise RuntimeError("a shard of this merge was replaced meanwhile")
                    return [*(s for s in shards if s.path not in gone), new]

                self._change(swap)
        return self.version()

    def vacuum(self) -> None:
        """Deletes the data of shards that the last version doesn't list; older versions can't be read afterwards."""
        live = {s.path for s in self.shards()}
        for top in self._fs.listStatus(self._path(f"{self.root}/data")):
            name = f"data/{top.getPath().getName()}"
            inner = [f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(top.getPath()) if s.isDirectory()]
            if name not in live and not live & set(inner):
                self._fs.delete(top.getPath(), True)
            elif name not in live:
                for path in set(inner) - live:
                    self._fs.delete(self._path(f"{self.root}/{path}"), True)

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.shards(version)
        if not shards:
            raise ValueError("the store is empty")
        return self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])


ARRIVALS = 9


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from the last version of a store that they arrived in piece by piece and that was then compacted."""
    store = ShardStore(spark, scratch_path(spark, "shards"))
    docs = documents(spark, sf_dir)
    store.append_arrivals(docs.withColumn("_arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "_arrival")
    store.compact()
    store.vacuum()
    rows = store.read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
