"""Token-id output: fixed-width bit packing with block offsets.

A dataset is a Parquet folder of *segments*, one row each: whole documents in ascending id order, their ids packed
most significant bit first at the least width that holds the vocabulary. A segment's payload is self-describing:

    magic "BPK1" | u8 bits | u32 ids in a block | u32 documents | u64 ids
    i64 doc_id[documents] | u64 first[documents + 1] | u64 byte offset of block[blocks] | packed ids

Blocks hold 4,096 ids, so each begins on a byte and can be unpacked alone. Spark's writer commits the files, so a
lost executor leaves no half-written shard and any store that Spark writes to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import documents, scratch_path

MAGIC, HEAD = b"BPK1", struct.Struct("<4sBIIQ")
BLOCK = 4096
#: A segment is closed at so many ids or documents; one longer document is a segment of its own.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 17, 1 << 14
SEGMENT_SCHEMA = "shard int, segment int, first_doc long, start_in_shard long, n_ids long, payload binary"


def width_for(vocabulary: int) -> int:
    """The least number of bits that holds the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    out = []
    for k in range(0, len(ids), BLOCK):
        part = np.unpackbits(ids[k : k + BLOCK].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
        out.append(np.packbits(part.reshape(-1)).tobytes())
    return b"".join(out)


def unpack_ids(packed: memoryview | bytes, n: int, bits: int) -> np.ndarray:
    """``n`` ids from the beginning of ``packed``."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f">u{bits // 8}", n).astype("<u4")
    out = np.empty(n, "<u4")
    step = BLOCK * bits // 8
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        at = k // BLOCK * step
        raw = np.frombuffer(packed, np.uint8, (m * bits + 7) // 8, at)
        rows = np.unpackbits(raw)[: m * bits].reshape(m, bits)
        full = np.zeros((m, 32), np.uint8)
        full[:, 32 - bits :] = rows
        out[k : k + m] = np.packbits(full, axis=1).view(">u4").reshape(-1)
    return out


def write_segment(doc_ids: list[int], id_bytes: list[bytes], bits: int) -> bytes:
    ids = np.frombuffer(b"".join(id_bytes), "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id doesn't fit {bits} bits")
    first = np.zeros(len(doc_ids) + 1, "<u8")
    np.cumsum([len(x) // 4 for x in id_bytes], out=first[1:])
    blocks = -(-len(ids) // BLOCK)
    offsets = np.arange(blocks, dtype="<u8") * np.uint64(BLOCK * bits // 8)
    return b"".join((HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids)), np.asarray(doc_ids, "<i8").tobytes(), first.tobytes(), offsets.tobytes(), pack_ids(ids, bits)))


class Segment:
    """A segment's payload: ``doc_ids``, ``first``, all ids at once or any range of them."""

    def __init__(self, payload: bytes):
        magic, self.bits, self.block, docs, self.n_ids = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a bit-packed segment")
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        self.first = np.frombuffer(payload, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(payload, "<u8", -(-self.n_ids // self.block), at := at + 8 * (docs + 1))
        self.packed = memoryview(payload)[at + 8 * len(self.offsets) :]

    def ids(self) -> np.ndarray:
        return unpack_ids(self.packed, self.n_ids, self.bits)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], reading only the blocks that hold them."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError((start, stop))
        if start == stop:
            return np.empty(0, "<u4")
        b0, b1 = start // self.block, (stop - 1) // self.block + 1
        n = min(self.n_ids, b1 * self.block) - b0 * self.block
        return unpack_ids(self.packed[int(self.offsets[b0]) :], n, self.bits)[start - b0 * self.block : stop - b0 * self.block]


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int, kind: type = tokens.WordBpe) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the dataset at ``path`` in ascending doc_id order.

    A null or empty text is just the end id. Rows without doc_id have no place in the order and are left out; rows
    with an equal doc_id follow each other. Other columns are ignored."""
    bits = width_for(vocabulary)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokens.encoder(kind, tokenizer_path).encode, np.asarray([end_id], "<u4").tobytes()
        shard, k, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        parts: list[bytes] = []
        held = 0

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "segment": [k], "first_doc": [ids[0]], "start_in_shard": [start], "n_ids": [held], "payload": [write_segment(ids, parts, bits)]})

        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                own = encode(text or "") + end
                if ids and (held + len(own) // 4 > SEGMENT_IDS or len(ids) >= SEGMENT_DOCS):
                    yield closed()
                    k, start, held, ids, parts = k + 1, start + held, 0, [], []
                ids.append(doc)
                parts.append(own)
                held += len(own) // 4
        if ids:
            yield closed()

    rows = docs.filter("doc_id is not null").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInPandas(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    A document's place is its segment's place in its shard after the totals of the shards before, of which there
    are as many as the writer had tasks."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, payload in zip(batch["start"].tolist(), batch["payload"], strict=True):
                seg = Segment(payload)
                raw, first = memoryview(seg.ids().tobytes()), seg.first.tolist()
                yield pd.DataFrame({
                    "doc_id": seg.doc_ids, "start": base + seg.first[:-1], "n_tokens": np.diff(seg.first),
                    "ids_crc32": np.asarray([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first, first[1:], strict=False)], np.int64),
                })

    placed = segments.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("start_in_shard")).alias("start"), "payload")
    return placed.mapInPandas(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-ids")
    write_token_ids(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return read_token_ids(spark, path)
