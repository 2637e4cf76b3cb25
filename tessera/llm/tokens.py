"""Token ids of whole texts as the tokenizers library gives them, by way of distinct parts.

Both vocabularies used here split a text first and merge inside the parts only, so the ids of a
text are the ids of its parts, one after another.  Arrow splits the texts and numbers their
distinct parts; each part that the memo doesn't hold goes to the library once, and the ids of
the texts are gathered from those of the parts.  A text that cannot be cut safely goes to the
library whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.shared import give_back

#: Parts in each of the two generations of the memo, and the longest part kept there.
MEMO, MEMO_CHARS = 400_000, 40
#: Characters of text taken together.
RUN_CHARS = 6 << 20


class LibraryEncoder:
    """Cuts a text where the library never merges across: around white space, and between a
    letter and a full stop or comma.  ``drops``: white space and the case of A-Z don't count;
    else a part keeps the white space before it.  ``unsafe`` finds the texts that no such rule
    fits, which go to the library whole."""

    def __init__(self, path: str, drops: bool, unsafe: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops, self.unsafe, self.memo = drops, unsafe, memo
        # Letters whose class, case and composition are the same in every Unicode version.
        self._plain = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ȯ]+" if drops else " ?[A-Za-zÀ-ÖØ-öø-ȯ]+")
        # Byte-level models name bytes by letters: those that are none move up from 256 on.
        unnamed = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self._table = {b: 256 + i for i, b in enumerate(unnamed)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _split(self, column: pa.Array) -> pa.Array:
        if self.drops:
            column = pc.replace_substring_regex(pc.ascii_lower(column), r"(\pL)([.,])", r"\1 \2")
            return pc.utf8_split_whitespace(column)
        column = pc.replace_substring(column, " ", "\0 ")
        column = pc.replace_substring_regex(column, r"(\pL)([.,])", "\\1\0\\2")
        column = pc.replace_substring_regex(column, r"([^\s\pZ\x00\x{85}\x1c-\x1f])\n", "\\1\0\n")
        return pc.split_pattern(column, "\0")

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of each part as 32-bit integers."""
        young, old = self.young, self.old
        out = list(map(young.get, parts))
        todo = [i for i, ids in enumerate(out) if ids is None]
        for i in todo:
            out[i] = old.get(parts[i])
        new = [i for i in todo if out[i] is None]
        for i, ids in zip(new, self._encode_new([parts[i] for i in new])):
            out[i] = ids
        for i in todo:
            part = parts[i]
            if len(part) <= MEMO_CHARS:
                young[part] = out[i]
        if len(young) > self.memo:
            self.old, self.young = young, {}
        return out

    def _encode_new(self, parts: list[str]) -> list[bytes]:
        """A part of plain letters is one word to the library: its model alone is asked.  The
        rest goes through all of the library."""
        plain, tokenize, table = self._plain.fullmatch, self.library.model.tokenize, self._table
        out: list[bytes | None] = []
        for p in parts:
            if plain(p):
                word = (p.lower() if self.drops else p).encode().decode("latin-1").translate(table)
                out.append(array("I", [t.id for t in tokenize(word)]).tobytes())
            else:
                out.append(None)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.library.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, one text after another, and the end of each text in them.  Each
        text's ids are followed by ``end_id`` if given."""
        # Nothing here makes cycles, and a collection would walk the whole memo each time.
        gc.disable()
        try:
            return self._encode(texts, end_id)
        finally:
            gc.freeze()
            gc.enable()
            give_back()

    def _encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(texts, pa.large_string())
        unsafe = pc.match_substring_regex(column, self.unsafe)
        whole = {i: self.library.encode(texts[i], add_special_tokens=False).ids for i in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))}
        split = self._split(pc.if_else(unsafe, pa.scalar(None, pa.large_string()), column) if whole else column)
        numbered = split.flatten().dictionary_encode()
        ids = self._ids_of(numbered.dictionary.to_pylist())
        number = numbered.indices.to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        sizes = size[number]
        ends = np.cumsum(sizes)
        shift = (np.cumsum(size) - size)[number] - (ends - sizes)
        out = flat[np.repeat(shift, sizes) + np.arange(len(shift) and int(ends[-1]))]
        text_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        if whole:
            cut = np.split(out, text_ends[:-1])
            for i, some in whole.items():
                cut[i] = np.array(some, np.uint32)
            out, text_ends = np.concatenate(cut).astype(np.uint32), np.cumsum([len(c) for c in cut])
        if end_id is not None:
            out = np.insert(out, text_ends, np.uint32(end_id))
            text_ends = text_ends + np.arange(1, len(texts) + 1)
        return out, text_ends


@lru_cache(4)
def word_encoder(path: str) -> LibraryEncoder:
    """For a vocabulary that drops white space and never merges across it.  The four control
    characters are white space to Arrow but not to the library."""
    return LibraryEncoder(path, True, r"[\x1c-\x1f]")


@lru_cache(4)
def piece_encoder(path: str, memo: int = MEMO) -> LibraryEncoder:
    """For a byte-level vocabulary whose words take one space before them.  Where three white
    space characters meet, which of them belong together depends on what follows; the null
    character marks the cuts."""
    return LibraryEncoder(path, False, r"[\s\pZ\x{85}\x0b\x1c-\x1f]{3}|\x00", memo)


def forget() -> None:
    """Free a worker's vocabularies and memos once a stage needs them no more."""
    word_encoder.cache_clear()
    piece_encoder.cache_clear()
    give_back()


def text_runs(texts: list[str | None], chars: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of a list that hold about so many characters each, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= chars):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end
