"""Byte-level BPE by backtracking over longest matches.

A token sequence is what greedy merging would give exactly when each adjacent pair of tokens
is compatible: undoing merges next to their border never finds a merge across it that greedy
merging would have made earlier.  So the encoder takes the longest token at each position,
falls back to the next shorter one where a pair is not compatible, and marks ends from which
no way leads on.  Every position is given up at most once, which keeps the time linear.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries in each of the two generations of the piece memo, and the longest piece kept there.
MEMO, MEMO_CHARS = 300_000, 40
#: Pieces handled at a time, so that a very long text needs no list of all its ids.
CHUNK = 1 << 16


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self._halves: dict[int, tuple[int, int]] = {}
        self._shorter: dict[int, int] = {}
        self._fits: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is its own half."""
        found = self._halves.get(token)
        if found is None:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = (self.ranks[parts[0]], self.ranks[parts[-1]]) if len(parts) == 2 else (token, token)
            self._halves[token] = found
        return found

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for a single byte."""
        found = self._shorter.get(token)
        if found is None:
            whole = self.bytes_of[token]
            found = next((r for n in range(len(whole) - 1, 0, -1) if (r := self.ranks.get(whole[:n])) is not None), -1)
            self._shorter[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether greedy merging keeps the border between these two adjacent tokens."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._border_holds(left, right)
            if len(self._fits) > 1 << 20:
                self._fits.clear()
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # The inner edges are split in the reverse order of their merges.  `made` is the rank
        # of the merge undone last: a merge across the border with a lower rank came before it.
        made = 1 << 60
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < made:
                return False
            left_whole, right_whole = self.length[left] == 1, self.length[right] == 1
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                made, left = left, self.halves(left)[1]
            else:
                # Of two equal ranks the left one merges first.
                made, right = right + 1, self.halves(right)[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (rank, size) in self.matcher.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends come in order, so the longest comes last
        length, dead, out, at = self.length, bytearray(n + 1), [], 0
        token = longest[0] if n else -1
        while token >= 0:
            last = out[-1] if out else -1
            while token >= 0 and (dead[at + length[token]] or (last >= 0 and not self.fits(last, token))):
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                out.pop()
                at -= length[last]
                token = last
        if at < n:
            raise ValueError(f"the vocabulary has no token for byte {piece[at]:#04x}")
        return out


class PieceMemo(dict):
    """Piece to ids, in two generations: what is used stays, and the size is bounded."""

    def __init__(self, encode, size: int = MEMO):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, piece: str):
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(piece) > MEMO_CHARS:
                return ids
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def pieces_of(pattern, text: str) -> Iterable[str]:
    return pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in pattern.finditer(text))


class TextCodec:
    """Encodes each match of a pattern on its own and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.codec = BytePairCodec(ranks)
        self.pattern = regex.compile(pattern)
        self.memo = PieceMemo(lambda piece: tuple(self.codec.encode_piece(piece.encode())))
        self.decimal = [str(i) for i in range(len(self.codec.bytes_of))]

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids in lists of bounded length."""
        found, look = iter(pieces_of(self.pattern, text)), self.memo.__getitem__
        while some := list(islice(found, CHUNK)):
            yield list(chain.from_iterable(map(look, some)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.codec.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        count, of_ids, of_bytes, first = 0, hashlib.sha256(), hashlib.sha256(), True
        for ids in self.encode(text):
            of_ids.update(("" if first else " ").encode() + " ".join(map(self.decimal.__getitem__, ids)).encode())
            of_bytes.update(self.decode(ids))
            count, first = count + len(ids), False
        return count, of_ids.hexdigest(), of_bytes.hexdigest()


@lru_cache(4)
def text_codec(path: str, pattern: str) -> TextCodec:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return TextCodec(ranks, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: (id, ids array<int>).  A null text counts as empty; null ids and
    repeated rows keep one row each.  Runs inside the scan's tasks, without a shuffle.

    ``vocabulary`` is a rank file that every executor has under this path.
    """

    def run(batches):
        codec = text_codec(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [list(chain.from_iterable(codec.encode(t or ""))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    key = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every id list: (id, bytes binary).  A null list gives null."""

    def run(batches):
        codec = text_codec(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                back = [None if i is None else codec.decode(i) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(back, pa.binary())], names=["id", "bytes"])

    key = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {key}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def codec_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip of every whole text in one pass: (id, n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the bytes that
    decoding these ids gives.  A null text counts as empty.  Memory for ids is bounded by
    ``CHUNK`` pieces, however long a text is.
    """

    def run(batches):
        codec = text_codec(vocabulary, pattern)
        for b in batches:
            rows = [codec.digest(t.as_py() or "") for t in b.column(1)]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    key = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)
