"""Token-id files in patched frame-of-reference blocks.

A shard is one file: header, document table, index of block starts, blocks.  A block holds up
to BLOCK ids less their minimum, packed at the width that suffices for the PERCENT-th
percentile; the rest are exceptions, kept as (position, high bits) after the packed part.
Shards travel as rows with a binary column, written and read by Spark alone, so any store that
Spark reaches will do and a lost executor costs the re-run of its tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, part_offsets
from tessera.llm.tokens import text_runs, word_encoder

MAGIC, BLOCK, PERCENT, SHARD_IDS = b"TPF1", 1024, 95, 1 << 20
_HEAD = struct.Struct("<4sIQQI")  # magic, block length, documents, ids, bytes of the length blocks
_BLOCK = struct.Struct("<IBHH")  # minimum, width, ids, exceptions


def _pack(values: np.ndarray, width: int) -> bytes:
    """Rows of ``values`` side by side at ``width`` bits, little end first."""
    if width == 0:
        return b""
    if width in (8, 16):
        return values.astype(f"<u{width // 8}").tobytes()
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, np.uint32)
    if width in (8, 16):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def pack_block(ids: np.ndarray) -> bytes:
    base = int(ids.min())
    rest = (ids - np.uint32(base)).astype(np.uint32)
    k = (len(rest) - 1) * PERCENT // 100
    width = int(np.partition(rest, k)[k]).bit_length()
    far = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, int)
    low = rest & np.uint32((1 << width) - 1) if len(far) else rest
    high = (rest[far] >> np.uint32(width)).astype("<u4")
    return _BLOCK.pack(base, width, len(ids), len(far)) + _pack(low, width) + far.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    base, width, n, far = _BLOCK.unpack_from(data)
    at = _BLOCK.size
    size = (n * width + 7) // 8
    out = _unpack(data[at : at + size], n, width)
    if far:
        where = np.frombuffer(data, "<u2", far, at + size)
        out[where] |= np.frombuffer(data, "<u4", far, at + size + 2 * far) << np.uint32(width)
    return out + np.uint32(base)


def _pack_all(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    return np.cumsum([0, *map(len, blocks)]).astype("<u8"), b"".join(blocks)


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in ids], np.uint32)
    null = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    length_starts, length_blocks = _pack_all(lengths)
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts, blocks = _pack_all(every)
    head = _HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(every), len(length_blocks))
    return b"".join((head, null, keys, length_starts.tobytes(), length_blocks, starts.tobytes(), blocks))


class Shard:
    """Reads a shard; ``ids(a, b)`` unpacks only the blocks that hold ids a to b."""

    def __init__(self, data: bytes):
        magic, self.block, n_docs, self.n_ids, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        null = np.unpackbits(np.frombuffer(data, np.uint8, (n_docs + 7) // 8, at))[:n_docs]
        at += (n_docs + 7) // 8
        self.doc_ids = [None if z else int(k) for k, z in zip(np.frombuffer(data, "<i8", n_docs, at), null)]
        at += 8 * n_docs
        count = -(-n_docs // self.block)
        where = np.frombuffer(data, "<u8", count + 1, at)
        at += 8 * (count + 1)
        parts = [unpack_block(data[at + a : at + b]) for a, b in zip(where[:-1], where[1:])]
        self.lengths = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        at += size
        count = -(-self.n_ids // self.block)
        self.where = np.frombuffer(data, "<u8", count + 1, at)
        self.data, self.at = data, at + 8 * (count + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        parts = [unpack_block(self.data[self.at + int(x) : self.at + int(y)]) for x, y in zip(self.where[a:b], self.where[a + 1 : b + 1])]
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the ids of every whole text, in ascending order of the id column (nulls first,
    equal ids by text): (part, shard, local_start, n_docs, n_ids, payload), as written.

    A null text counts as empty, so it has the end id only.  One text's ids never span shards.
    """
    schema = "part int, shard int, local_start long, n_docs int, n_ids long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]):
        encoder, part = word_encoder(vocabulary), TaskContext.get().partitionId()
        keys, ids, held, shard, start = [], [], 0, 0, 0

        def row():
            columns = [[part], [shard], [start], [len(keys)], [held], [write_shard(keys, ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "shard", "local_start", "n_docs", "n_ids", "payload"])

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for at, end in text_runs(texts):
                flat, ends = encoder.encode([t or "" for t in texts[at:end]], end_id)
                for key, x in zip(doc_ids[at:end], np.split(flat, ends[:-1])):
                    if keys and held + len(x) > SHARD_IDS:
                        yield row()
                        keys, ids, held, shard, start = [], [], 0, shard + 1, start + held
                    keys.append(key)
                    ids.append(x)
                    held += len(x)
        if keys:
            yield row()

    in_order = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("id"))
        .sortWithinPartitions("id", "text")
    )
    return scratch.cut(in_order.mapInArrow(run, schema), "shards", codec="uncompressed")


def read_ids(shards: DataFrame) -> DataFrame:
    """Every document of the shards: (doc_id, start, n_tokens, ids_crc32).  ``start`` counts the
    ids of all documents before it, by prefix sums over the partitions' totals."""
    base = part_offsets(shards, "part", "n_ids")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for part, at, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = Shard(payload)
                ends = np.cumsum(s.lengths, dtype=np.int64)
                ids = s.ids(0, s.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, s.lengths.astype(np.int64))]
                first = base[part] + at + ends - s.lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(first, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "local_start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
