"""N-gram Jaccard self-join with PartEnum signatures (Arasu, Ganti, Kaushik, "Efficient exact set-similarity joins").

Sets of word shingles whose Jaccard similarity is at least 3/4 differ in a bounded number of elements, given a band of
sizes. The domain of shingle hashes is partitioned so finely that in at least one partition (for small sets: in one
subset of the partitions, all subsets of that size being enumerated) two such sets agree and aren't empty; a hash of
what a set holds there is its signature. No linked pair is missed; what else shares a signature is compared and dropped.

Skew. Each task first combines its own documents: of those that share a signature only the least goes on, the others
become an edge to it. So a signature that a third of all documents share costs a row for each task, and its members
form a tree, not pairs. Trees are verified edge by edge. Only where a tree still joins different components (documents
that share a signature and aren't alike) its members are compared across components, and of those only members that can
still have a partner: a linked pair agrees in so many partitions that both share a known number of signatures. A document that
holds fewer in such trees is out, and of the others' signatures the most frequent, one fewer than that number, say nothing
that the rarer ones don't; so a passage that many documents have doesn't make them meet.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, discard, documents, mix, shuffle_partitions, stored, window_hashes
from .components import connected_components

WIDTH = 5
#: Similarity 75 of 100 as fixed integers: 100 * shared >= 75 * union, hence 175 * shared >= 75 * (a + b).
PERCENT = 75
#: Cells of the size sketch; a power of two.
CELLS = 1024
#: Documents that a task combines before it sends signatures on: bounds its memory together with the signatures.
CHUNK_SIGNATURES = 800_000
#: Bytes of text whose sets are taken in one vectorised pass; a longer text goes alone.
CHUNK_BYTES = 500_000
#: Ids of documents to compare are broadcast up to this number, 16 MB; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: A group of a signature with more members than this is compared in tiles of about this many.
TILE = 1024
PAIRS_AT_ONCE = 100_000


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes of five-word shingles, ascending; of the whole sequence if it is shorter; none without words."""
    words = hashes.of(text.encode().lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(WIDTH, len(words))
    h = window_hashes(words, width)
    return np.unique(h if width == WIDTH else mix(h + np.uint64(width)))


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """doc_id and text of neighbouring rows, about CHUNK_BYTES of text at a time; only those become Python strings."""
    ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ids)]
    for lo, hi in itertools.pairwise(cuts):
        if hi > lo:
            yield ids[lo:hi], [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]


def shingle_sets(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_set`` of each text, one after another, and their sizes."""
    split = [t.encode().lower().split() for t in texts]
    lens = np.asarray([len(w) for w in split], np.int64)
    words = hashes.of(list(itertools.chain.from_iterable(split)))
    starts = np.cumsum(lens) - lens
    short = np.flatnonzero((lens > 0) & (lens < WIDTH))
    many = np.maximum(lens - WIDTH + 1, 0)
    many[short] = 1
    begins = np.cumsum(many) - many
    # where in ``words`` each window starts
    at = np.arange(many.sum()) + np.repeat(starts - begins, many)
    every = window_hashes(words, WIDTH)
    values = every[np.minimum(at, len(every) - 1)] if len(every) else np.zeros(len(at), np.uint64)
    for d in short.tolist():
        values[begins[d]] = mix(window_hashes(words[starts[d] : starts[d] + lens[d]], int(lens[d])) + np.uint64(lens[d]))[0]
    for lo, n in zip(begins.tolist(), many.tolist(), strict=True):
        values[lo : lo + n].sort()
    owner = np.repeat(np.arange(len(texts)), many)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(texts))


def linked(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


def band_of(n: int) -> int:
    return int(np.searchsorted(_TOPS, n))


def _tops() -> np.ndarray:
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append((tops[-1] + 1) * 100 // PERCENT)
    return np.asarray(tops)


#: The largest size of each band; the next band holds the sizes from there to 4/3 of the following one.
_TOPS = _tops()


class Instance:
    """The signatures for pairs whose smaller set is in ``band``; the larger one is in it or in the next.

    Such a pair differs in at most ``k`` elements. The domain is cut into ``cells`` and each of them into ``parts``; in
    at least cells - k // (miss + 1) cells the pair differs in at most ``miss`` elements, so there it agrees on some
    choice of parts - miss parts, and every such choice gives a signature. Small sets: one cell, many choices. Middle
    sizes: some cells. Large sets: more cells than k, of one part each."""

    def __init__(self, band: int):
        top = int(_TOPS[band])
        # a + b - 2 * shared, where 175 * shared >= 75 * (a + b), and b <= 4/3 a
        self.k = k = (top + top * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
        if k <= 3:
            self.cells, self.parts, self.miss = 1, 2 * k + 2, k
        elif k <= 24:
            self.cells, self.parts, self.miss = k // 3 + 2 + k // 12, 5, 2
        else:
            self.cells, self.parts, self.miss = k + 3 + k // 3, 1, 0
        self.choices = np.asarray(list(itertools.combinations(range(self.parts), self.parts - self.miss)))
        self.agreeing = self.cells - k // (self.miss + 1)
        self.seed = mix(np.asarray([band + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        names = np.arange(1, self.cells * len(self.choices) + 1, dtype=np.uint64).reshape(self.cells, -1)
        self.names, self.odd = mix(names + self.seed), np.uint64(band & 1)

    def signatures(self, u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """u: ascending hashes of each set in turn. Signatures, the place of their set, and how many of its signatures a set
        shares at least with any set linked to it. A part is a range of hashes, so the elements of one are neighbours. The last
        bit of a signature tells instances of neighbouring bands apart."""
        wide = self.cells * self.parts
        part = ((u >> np.uint64(32)) * np.uint64(wide)) >> np.uint64(32)
        slot = part.astype(np.int64) + np.repeat(np.arange(len(counts)) * wide, counts)
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        full = np.zeros(len(counts) * wide, np.uint64)
        full[slot[first]] = np.add.reduceat(mix(u ^ self.seed), first)
        held = full.reshape(len(counts), self.cells, self.parts)[:, :, self.choices]
        out, some = mix(held.sum(axis=3, dtype=np.uint64) + self.names), (held != 0).any(axis=3)
        out = (out & ~np.uint64(1)) | self.odd
        # Empty choices say nothing, unless this set has so many that a partner might agree with it on those only.
        sure = self.agreeing - (~some).any(axis=2).sum(axis=1)
        some |= (sure <= 0)[:, None, None]
        return out[some], np.repeat(np.arange(len(counts)), some.sum(axis=(1, 2))), np.maximum(sure, 1)


_INSTANCES: dict[int, Instance] = {}


def signatures(u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of sets given one after another, the place of each one's set (a set may repeat one), and for each set
    how many even and odd ones it shares at least with a set that is linked to it in the instance of that kind."""
    band = np.where(counts > 0, np.searchsorted(_TOPS, counts), -2)
    needs = np.ones((len(counts), 2), np.int64)
    sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    held = np.unique(band[band >= 0])
    for b in np.unique(np.concatenate((held, held[held > 0] - 1))).tolist():
        if b not in _INSTANCES:
            _INSTANCES[b] = Instance(b)
        of = (band == b) | (band == b + 1)
        sig, owner, needs[of, b & 1] = _INSTANCES[b].signatures(u[np.repeat(of, counts)], counts[of])
        sigs.append(sig)
        owners.append(np.flatnonzero(of)[owner])
    return np.concatenate(sigs), np.concatenate(owners), needs


def sketches(u: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit for each cell: whether an odd number of elements falls in it. Sets differ in an element at least where bits differ."""
    cell = (u & np.uint64(CELLS - 1)).astype(np.int64) + np.repeat(np.arange(len(counts)) * CELLS, counts)
    odd = np.bincount(cell, minlength=len(counts) * CELLS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(counts), CELLS), axis=1)


def fingerprints(u: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, as two longs."""
    ends = np.cumsum(counts)
    sums = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(u + np.uint64(s)), dtype=np.uint64))) for s in (1, 2))
    return [(total[ends] - total[ends - counts]).view(np.int64) for total in sums]


def _runs(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct signatures, the least owner of each, and edges to the others as columns: signature, least, other."""
    order = np.argsort(sig)
    sig, owner = sig[order], owner[order]
    lead = np.concatenate(([True], sig[1:] != sig[:-1]))
    starts = np.flatnonzero(lead)
    least = np.minimum.reduceat(owner, starts)
    run = np.cumsum(lead) - 1
    rest = np.flatnonzero(owner != least[run])
    return sig[starts], least, (sig[rest], least[run[rest]], owner[rest])


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _names(sig: np.ndarray, buckets: int) -> np.ndarray:
    """A signature's name in results: its bucket, of which there are at most 2**15, and 48 of its bits. If two signatures had
    one name, their documents would be compared, no more."""
    return (sig & np.uint64((1 << 48) - 1)).astype(np.int64) | (_bucket(sig, buckets) << 48)


#: An edge of a signature's tree, or (sketch isn't null) the description of document x.
ROWS = "sig long, x long, y long, n_shingles long, f1 long, f2 long, even long, odd long, sketch binary"
ROW_TYPES = [pa.int64()] * 8 + [pa.binary()]


def signature_trees(docs: DataFrame, tasks: int) -> DataFrame:
    """For each signature that documents share, edges sig, x, y that make a tree of them; x is the lesser id. From the same
    pass over the texts a row for each document: x, the size of its set, a 128-bit fingerprint, the numbers of even and odd
    signatures that it shares with a linked one, and the sketch."""

    buckets = min(3 * tasks, 1 << 15)

    def part(bucket: int, sigs: bytes, ids: bytes, owners: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in (sigs, ids, owners))], names=["bucket", "sigs", "ids", "owners"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig = np.concatenate(sigs)
            owner = np.concatenate(owners)
            s, o, (shared, x, y) = _runs(sig, owner)
            for k in range(0, len(x), 500_000):
                at = slice(k, k + 500_000)
                local = np.stack((_names(shared[at], buckets), x[at], y[at]), axis=1)
                yield part(-1, local.tobytes(), b"", b"")
            bucket = _bucket(s, buckets)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if hi > lo:
                    ids, index = np.unique(o[lo:hi], return_inverse=True)
                    yield part(int(b), s[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), ids.tobytes(), index.astype("<u4" if len(ids) > 65_535 else "<u2").tobytes())

        for batch in batches:
            for ids, texts in chunks(batch):
                u, counts = shingle_sets(texts, hashes)
                sig, owner, needs = signatures(u, counts)
                facts = np.stack((ids, counts, *fingerprints(u, counts), *needs.T), axis=1)
                yield part(-2, sketches(u, counts).tobytes(), facts.tobytes(), b"")
                sigs.append(sig)
                owners.append(ids[owner])
                held += len(sig)
                if held >= CHUNK_SIGNATURES:
                    yield from flush()
                    sigs, owners, held = [], [], 0
        if held:
            yield from flush()

    def framed(sig, x, y, n=None, f1=None, f2=None, even=None, odd=None, sketch=None) -> pa.RecordBatch:
        made = zip((sig, x, y, n, f1, f2, even, odd, sketch), ROW_TYPES, strict=True)
        return pa.RecordBatch.from_arrays([pa.nulls(len(x), t) if v is None else pa.array(v, t) for v, t in made], names=[c.split()[0] for c in ROWS.split(", ")])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, s, ids, o in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "ids", "owners")), strict=True):
                if bucket == -2:
                    facts = np.frombuffer(ids, np.int64).reshape(-1, 6)
                    yield framed(None, facts[:, 0], None, *facts[:, 1:].T, [s[k : k + CELLS // 8] for k in range(0, len(s), CELLS // 8)])
                elif bucket == -1:
                    local = np.frombuffer(s, np.int64).reshape(-1, 3)
                    yield framed(*local.T)
                else:
                    own.setdefault(bucket, []).append((s, ids, o))
        while own:
            bucket, parts = own.popitem()
            sig, owner = [], []
            for s, ids, o in parts:
                n = len(s) // 6
                full = np.zeros((n, 8), np.uint8)
                full[:, :6] = np.frombuffer(s, np.uint8).reshape(n, 6)
                sig.append(full.view("<u8").reshape(-1))
                who = np.frombuffer(ids, np.int64)
                owner.append(who[np.frombuffer(o, "<u2" if len(o) == 2 * n else "<u4")])
            _, _, (shared, x, y) = _runs(np.concatenate(sig) | np.uint64(bucket << 48), np.concatenate(owner))
            yield framed(shared.view(np.int64), x, y)

    sent = docs.select("doc_id", "text").mapInArrow(combined, "bucket int, sigs binary, ids binary, owners binary")
    # a bucket's rows meet in one task; local edges, which need not, stay spread
    spread = F.when(F.col("bucket") < 0, F.xxhash64("sigs", "ids")).otherwise(F.col("bucket").cast("long"))
    return sent.withColumn("spread", spread).repartition(tasks, "spread").drop("spread").mapInArrow(met, ROWS)


PAIR = "x long, y long"


def plausible_difference(differ, a, b):
    """Whether sets of sizes a and b that differ in at least ``differ`` elements can be linked."""
    return 200 * (a + b - differ) >= 2 * PERCENT * (a + b + differ)


def plausible(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return plausible_difference(np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64), a, b)


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, CELLS // 64)


def with_description(pairs: DataFrame, desc: DataFrame) -> DataFrame:
    for side in "xy":
        pairs = pairs.join(desc.select(*[F.col(c).alias(f"{c}_{side}") for c in desc.columns]), F.col(side) == F.col(f"doc_id_{side}")).drop(f"doc_id_{side}")
    return pairs


def sifted(pairs: DataFrame, desc: DataFrame) -> DataFrame:
    """x, y, same: the pairs that sizes and sketches don't rule out, and whether both sets are the same."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ok = plausible(_sketches(b["sketch_x"]), _sketches(b["sketch_y"]), b["n_shingles_x"].to_numpy(), b["n_shingles_y"].to_numpy())
                same = (b["f1_x"] == b["f1_y"]) & (b["f2_x"] == b["f2_y"]) & (b["n_shingles_x"] == b["n_shingles_y"])
                yield pd.DataFrame({"x": b["x"], "y": b["y"], "same": same})[ok]

    return with_description(pairs, desc).mapInPandas(rows, f"{PAIR}, same boolean")


def fine_sketch(u: np.ndarray) -> bytes:
    """How many elements fall in each of about as many cells; a tenth of the set's bytes."""
    cells = 1 << max(7, (len(u) - 1).bit_length())
    return np.minimum(np.bincount((u & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def fine_plausible(p: bytes, q: bytes, a: int, b: int) -> bool:
    """Counts are capped at 255, which never makes their differences larger."""
    u, v = (np.frombuffer(x, np.uint8).astype(np.int32) for x in (p, q))
    cells = min(len(u), len(v))
    return bool(plausible_difference(int(np.abs(u.reshape(-1, cells).sum(axis=0) - v.reshape(-1, cells).sum(axis=0)).sum()), a, b))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, y of the pairs that are linked. Fine sketches go first; the whole sets only of pairs that those can't rule out."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for ids, texts in chunks(b):
                u, counts = shingle_sets(texts, hashes)
                own = np.split(u, np.cumsum(counts)[:-1])
                columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array([fine_sketch(v) for v in own], pa.binary()), pa.array([v.tobytes() for v in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "fine", "elements"])

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [fine_plausible(*r) for r in zip(b["fine_x"], b["fine_y"], b["n_x"], b["n_y"], strict=True)]
            yield b.loc[ok, ["x", "y"]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            # the sets are read where they are, without a copy
            for p, q in zip(b.column("elements_x"), b.column("elements_y"), strict=True):
                u, v = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                ok.append(linked(int((v[at] == u).sum()), len(u), len(v)))
            yield b.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    wanted = stored(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    found = stored(docs.join(side, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc long, n long, fine binary, elements binary"), "shingle-sets")

    def with_columns(of: DataFrame, columns: list[str]) -> DataFrame:
        for s in "yx":
            of = of.join(found.select(F.col("doc").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]), s)
        return of

    close = stored(with_columns(pairs.select("x", "y"), ["n", "fine"]).mapInPandas(sift, PAIR), "close")
    out = stored(with_columns(close, ["elements"]).mapInArrow(compare, PAIR), "linked")
    discard(wanted, found, close)
    return out


def across(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """members(sig, doc, f1, f2, component, n_shingles, sketch) -> x, y: documents of one signature and different components
    that the sketches of some of their texts don't rule out. A signature with many members is dealt out in tiles, any two of which meet once."""
    large = members.groupBy("sig").count().filter(F.col("count") > TILE).select("sig", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    dealt = members.join(large, "sig", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in itertools.chain(batches, [None]):
            held = b if rest is None else rest if b is None else pd.concat((rest, b), ignore_index=True)
            if held is None or not len(held):
                continue
            key = held[["sig", "t1", "t2"]].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(held)]))
            # the last group may go on in the next batch
            whole = len(held) if b is None else int(starts[-2])
            rest = held.iloc[whole:].reset_index(drop=True)
            g = held.iloc[:whole]
            if not whole:
                continue
            # a doc_id may have several texts, each with a size and a sketch
            who = g.groupby(["doc", "f1", "f2"], sort=False).ngroup().to_numpy()
            first = np.unique(who, return_index=True)[1]
            docs = g["doc"].to_numpy()[first]
            sk, size, tile, split = _sketches(g["sketch"].iloc[first]), g["n_shingles"].to_numpy()[first], g["tile"].to_numpy(), (g["t1"] != g["t2"]).to_numpy()
            # a row meets those of its group that come after its component
            ends, c = np.repeat(starts[1:], np.diff(starts))[:whole], g["component"].to_numpy()
            runs = np.unique(np.concatenate((starts, np.flatnonzero(c[1:] != c[:-1]) + 1)))
            runs = runs[runs <= whole]
            after = np.repeat(runs[1:], np.diff(runs))
            many = ends - after
            done, total = 0, np.cumsum(many)
            while done < whole:
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE)))
                block = np.arange(done, min(upto, whole))
                k = many[block]
                i = np.repeat(block, k)
                j = after[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
                ok = ~split[i] | (tile[i] != tile[j])
                u, v = who[i[ok]], who[j[ok]]
                fits = 100 * np.minimum(size[u], size[v]) >= PERCENT * np.maximum(size[u], size[v])
                pair = np.unique((np.minimum(u, v)[fits] << 32) | np.maximum(u, v)[fits])
                u, v = pair >> 32, pair & 0xFFFFFFFF
                ok = plausible(sk[u], sk[v], size[u], size[v])
                if ok.any():
                    x, y = docs[u[ok]], docs[v[ok]]
                    yield pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})
                done = int(block[-1]) + 1

    keys = ["sig", "t1", "t2"]
    return dealt.select(*keys, "tile", "doc", "f1", "f2", "component", "n_shingles", "sketch").repartition(tasks or shuffle_partitions(members), *keys).sortWithinPartitions(*keys, "component").mapInPandas(rows, PAIR).distinct()


def _labelled(df: DataFrame, components: DataFrame, node: str, label: str) -> DataFrame:
    own = components.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(own, F.col(node) == F.col("_node"), "left").withColumn(label, F.coalesce("_component", node)).drop("_node", "_component")


#: What a row's document must share of its signature's kind.
NEED = "CASE WHEN sig % 2 = 0 THEN even ELSE odd END"


def narrowed(members: DataFrame) -> DataFrame:
    """members(sig, weight, doc, component, even, odd) without what can't be shared with a linked document of another component: documents
    that hold fewer signatures of a kind than they would share, then signatures of one component. Adds n, the documents of a signature."""
    own = Window.partitionBy("doc", F.col("sig").bitwiseAND(1))
    able = members.withColumn("_held", F.sum("weight").over(own)).filter(F.col("_held") >= F.expr(NEED)).drop("_held")
    open_sigs = able.groupBy("sig").agg(F.count("*").alias("n"), F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high").select("sig", "n")
    return able.join(open_sigs, "sig")


def same_members(members: DataFrame) -> DataFrame:
    """One signature, its least, for all of a kind that have the same documents, and their number as weight."""
    sets = members.groupBy("sig").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), "doc")).alias(f"h{seed}") for seed in (1, 2)])
    return sets.groupBy("n", "h1", "h2", F.col("sig").bitwiseAND(1)).agg(F.min("sig").alias("sig"), F.count("*").alias("weight")).select("sig", "weight")


def thinned(members: DataFrame) -> DataFrame:
    """members(..., n) without the most frequent signatures of each document, one fewer than it shares with a linked one: under one order
    for all documents, the rarest signature that both share stays with both."""
    order = Window.partitionBy("doc", F.col("sig").bitwiseAND(1)).orderBy(F.desc("n"), "sig").rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumn("_rank", F.sum("weight").over(order)).filter(F.col("_rank") >= F.expr(NEED)).drop("_rank", "n")


def similar_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id: the least doc_id reachable by links, its own without any.

    A null, empty or blank text has no shingles and no link. Rows without doc_id are left out. Rows with an equal doc_id are
    one document, linked with whatever one of its texts is linked with. Other columns are ignored."""
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    tasks = shuffle_partitions(docs)
    both = stored(signature_trees(docs, tasks), "trees")
    desc = stored(both.filter("sketch is not null").select(F.col("x").alias("doc_id"), "n_shingles", "f1", "f2", "even", "odd", "sketch"), "described")
    trees = both.filter("y is not null").select("sig", "x", "y")
    # equal sets are linked with the least document that has them, which stands for all from the second round on
    same = ["f1", "f2", "n_shingles"]
    kinds = stored(desc.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("even", "odd", "sketch")]), "kinds")
    copies = desc.join(kinds.filter("rows > 1").select(*same, "doc"), same).select(F.col("doc").alias("x"), F.col("doc_id").alias("y")).filter("x <> y")

    edges = stored(trees.select("x", "y").distinct(), "tree-pairs")
    first = stored(sifted(edges, desc), "pairs")
    close = verified(docs, first.filter("not same"))
    found = connected_components(close.unionByName(copies))
    discard(close)

    # trees that still join different components
    unlike = _labelled(_labelled(edges, found, "x", "cx"), found, "y", "cy").filter("cx <> cy").select("x", "y")
    open_sigs = stored(trees.join(unlike, ["x", "y"], "left_semi").select("sig").distinct(), "open")
    needs = kinds.groupBy("doc").agg(F.min("even").alias("even"), F.min("odd").alias("odd"))
    every = trees.join(open_sigs, "sig", "left_semi").select("sig", F.explode(F.array("x", "y")).alias("doc")).distinct()
    every = stored(every.join(needs, "doc"), "members")
    discard(both, edges, open_sigs)
    members = stored(_labelled(every.join(same_members(every), "sig"), found, "doc", "component"), "members")
    discard(every)
    members = _narrowed(members)

    # a document of each component with one of another, chosen anew for each signature: merges groups of copies whose leader was far off
    reps = members.groupBy("sig", "component").agg(F.min_by("doc", F.xxhash64("sig", "doc")).alias("rep"))
    hubs = reps.groupBy("sig").agg(F.min_by("rep", F.xxhash64("sig", "rep")).alias("hub"))
    again = reps.join(hubs, "sig").select(F.least("rep", "hub").alias("x"), F.greatest("rep", "hub").alias("y")).filter("x <> y").distinct()
    second = stored(sifted(again.join(first, ["x", "y"], "left_anti"), desc), "pairs")
    found, members = _merged(docs, second, found), members.drop("component", "n")

    # the rest: all that can still be linked across components, each set of members once
    members = _narrowed(stored(_labelled(members, found, "doc", "component"), "members"), members)
    thin = stored(thinned(members), "members")
    discard(members)
    several = thin.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("sig")
    once = same_members(thin).select("sig").join(several, "sig")
    thin_once = thin.join(once, "sig", "left_semi").join(kinds.select("doc", *same, "sketch"), "doc")
    tried = first.select("x", "y").unionByName(second.select("x", "y"))
    more = stored(across(thin_once, tasks).join(tried, ["x", "y"], "left_anti"), "pairs")
    discard(thin, kinds, first, second)
    if not more.isEmpty():
        found = _merged(docs, more, found)
    return _labelled(desc.select("doc_id", "n_shingles"), found, "doc_id", "component_id")


def _narrowed(members: DataFrame, *used: DataFrame) -> DataFrame:
    """``narrowed`` until a turn takes little away (what is left is compared); ``members``, a stored table, and ``used`` are deleted."""
    before = members.count()
    while True:
        less = stored(narrowed(members.drop("n")), "members")
        discard(members, *used)
        members, used, after = less, (), less.count()
        if after >= 0.9 * before:
            return members
        before = after


def _merged(docs: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The components that the linked ones of ``pairs`` make of those ``found`` before, which are deleted."""
    close = verified(docs, pairs.select("x", "y"))
    merged = connected_components(close.unionByName(found.select(F.col("component").alias("x"), F.col("node").alias("y"))))
    discard(close, found)
    return merged


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)]
    ELSE list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i+4])) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.least FROM reach r JOIN edges e ON e.x = r.doc_id AND r.least < e.y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.least) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
