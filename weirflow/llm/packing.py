"""Best-fit packing: hierarchical residual packing of documents into sequences of a fixed number of tokens.

Documents are encoded once into small piece records (place, length, checksum). Each task packs its pieces by best-fit
decreasing and emits bins that are nearly full; bins with more room become the items of the next round, which merges
the tasks of the last one by a fan-in, until one task holds them or merging no longer helps. A bin carries its
members, so no join is needed.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents, stored

LENGTH = 2048
#: A bin with at most this much room is nearly full and final.
SLACK = 4
#: Tasks that meet in one task of the next round, and the items that one task takes at most on average.
FAN_IN, TASK_ITEMS = 8, 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])


def cut_sizes(n: int, length: int) -> list[int]:
    """Sizes of a document's pieces: only the first may be shorter than ``length``."""
    whole, rest = divmod(n, length)
    return [rest] * bool(rest) + [length] * whole


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, kind: type = tokens.ByteBpe) -> DataFrame:
    """One row for each piece of each document; a null or empty text is just the end id. Other columns are ignored."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokens.encoder(kind, tokenizer_path).encode, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = memoryview(encode(text or "") + end)
                at = 0
                for k, size in enumerate(cut_sizes(len(raw) // 4, length)):
                    out.append((doc, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at += size
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(rows, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, largest first, goes where the least room is left. Returns the items of each bin.

    Bins are kept by their room; an integer's bits say which rooms exist, so the tightest fit is found in a few
    machine operations however many bins there are."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for k in order:
        size = sizes[k]
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


BINS = "bin long, fill int, members binary"


def _packed(items: list[tuple[int, bytes]], round_no: int, length: int) -> pd.DataFrame:
    task = TaskContext.get().partitionId()
    bins = best_fit([size for size, _ in items], length)
    first = (round_no << 56) | (task << 32)
    return pd.DataFrame({
        "bin": np.arange(len(bins), dtype=np.int64) + first,
        "fill": np.asarray([sum(items[k][0] for k in b) for b in bins], np.int32),
        "members": [b"".join(items[k][1] for k in b) for b in bins],
    })


def pack(pieces_df: DataFrame, length: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``length`` tokens. No piece is lost or cut; a sequence holds at
    most ``length`` tokens, gapless from offset 0. An empty input gives an empty result.

    Rounds end once one task has met all open bins or, where they are too many for one, when a round saves under a
    thousandth of them: what is still open then stays as it is."""

    def first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: list[tuple[int, bytes]] = []
        for batch in batches:
            record = np.empty(len(batch), MEMBER)
            for name in ("doc_id", "piece", "start", "length"):
                record[name] = batch[name].to_numpy()
            record["crc"] = batch["ids_crc32"].to_numpy()
            raw, w = record.tobytes(), MEMBER.itemsize
            items += [(int(n), raw[k * w : k * w + w]) for k, n in enumerate(batch["length"].tolist())]
        yield _packed(items, 0, length)

    def later(round_no: int):
        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items = [x for batch in batches for x in zip(batch["fill"].tolist(), batch["members"], strict=True)]
            yield _packed(items, round_no, length)

        return merge

    bins = stored(pieces_df.mapInPandas(first_round, BINS), "bins")
    full = F.col("fill") >= length - slack
    done, open_bins, tasks = [bins.filter(full)], bins.filter(~full), bins.rdd.getNumPartitions()
    n_open = open_bins.count()
    for round_no in itertools.count(1):
        if n_open < 2 or tasks == 1 and round_no > 1:
            break
        fewer = max(-(-tasks // FAN_IN), -(-n_open // TASK_ITEMS))
        merged = stored(open_bins.repartition(fewer).mapInPandas(later(round_no), BINS), "bins")
        done.append(merged.filter(full))
        open_bins, before, n_open = merged.filter(~full), n_open, merged.filter(~full).count()
        if fewer == 1 or fewer >= tasks and n_open > 0.999 * before:
            break
        tasks = fewer
    done.append(open_bins)

    def unfolded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            held = [np.frombuffer(m, MEMBER) for m in batch["members"]]
            record, counts = np.concatenate(held), [len(h) for h in held]
            sizes = record["length"].astype(np.int64)
            ends = np.cumsum(sizes)
            firsts = np.cumsum([0, *counts])[:-1]
            base = np.repeat((ends - sizes)[firsts], counts)
            yield pd.DataFrame({
                "doc_id": record["doc_id"], "piece": record["piece"], "start": record["start"], "length": sizes, "ids_crc32": record["crc"].astype(np.int64),
                "sequence_id": np.repeat(batch["bin"].to_numpy(), counts), "offset": ends - sizes - base,
            })

    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.mapInPandas(unfolded, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer_path, end_id, length), "pieces"), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
