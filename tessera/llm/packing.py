"""Concatenate-and-cut packing of token ids into fixed windows.

First pass: ids of every document with its start inside its partition, written once.  The
partitions' totals give, by prefix sums, each document's place in the one long run of ids.
Second pass: windows of fixed length cut that run; a document that crosses a border gets one
record for each side.  Only the last window is short, which is all the padding there is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, part_offsets
from tessera.llm.tokens import MEMO, RUN_CHARS, forget, piece_encoder, text_runs

#: Documents cut together.
ROWS_CUT = 250


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, run_chars: int = RUN_CHARS) -> DataFrame:
    """(part, local_start, doc_id, n, ids binary of little-endian 32-bit ids), as written.

    ``memo`` and ``run_chars`` trade a worker's memory for time and change no result.
    A null text counts as empty and has the end id only; rows with null or repeated ids stay.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        encoder, part, start = piece_encoder(vocabulary, memo), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for at, end in text_runs(texts, run_chars):
                flat, ends = encoder.encode([t or "" for t in texts[at:end]], end_id)
                n = np.diff(ends, prepend=0)
                before = start + ends - n
                start += len(flat)
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), pa.array(before), b.column(0).slice(at, end - at), pa.array(n), ids.cast(pa.binary())],
                    names=["part", "local_start", "doc_id", "n", "ids"],
                )

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scratch.cut(named.mapInArrow(run, f"part int, local_start long, doc_id {key}, n long, ids binary"), "ids")


def pack(docs: DataFrame, vocabulary: str, end_id: int, scratch: Scratch, window: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, run_chars: int = RUN_CHARS) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset[, ids]).  Every id of every document lies in exactly one piece; offsets inside a
    sequence leave no gap.  An empty table gives no rows."""
    tokens = tokenize(docs, vocabulary, end_id, scratch, id_col, text_col, memo, run_chars)
    base = part_offsets(tokens, "part", "n")
    key = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        for b in (x.slice(at, ROWS_CUT) for x in batches for at in range(0, x.num_rows, ROWS_CUT)):
            doc, out = [], [[] for _ in range(6)]
            for row, (part, local, n, raw) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)))):
                first, at = base[part] + local, 0
                while at < n:
                    place = first + at
                    size = min(n - at, window - place % window)
                    piece = raw[4 * at : 4 * (at + size)]
                    for c, v in zip(out, (at, size, zlib.crc32(piece), n, place // window, place % window)):
                        c.append(v)
                    doc.append(row)
                    at += size
            columns = [b.column(2).take(pa.array(doc, pa.int32())), *(pa.array(c, pa.int64()) for c in out)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                # The pieces of a document, and documents, follow each other without a gap.
                ids = np.frombuffer(b"".join(b.column(4).to_pylist()), "<i4")
                columns.append(pa.ListArray.from_arrays(np.cumsum([0, *out[1]]).astype(np.int32), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids) from pieces with ids, padded to ``window``; a group has ``window`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    whole = pieces.groupBy("sequence_id").agg(ids.alias("ids"))
    return whole.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.greatest(F.lit(window) - F.size("ids"), F.lit(0)))))
