import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, packing, pfor, tokens, url_rules
from tessera.llm.shared import Scratch

ODD = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'LL", "1", "42", "!", "é", "e\u0301", "ß", "\x1c", "\x85", "\u00a0", "漢", "😀", "İ", "Σ", "---", "<|endoftext|>", "<|startoftext|>"]
TEXTS = [None, "", " ", "the", "x" * 5000, " ".join(["the and thnt"] * 40000)] + [
    "".join(random.Random(i).choice(ODD) for _ in range(i % 60)) for i in range(400)
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n_tokens", "part") for i, t in enumerate(TEXTS)] + [(None, "no id", "", ""), (3, "the", "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, part string").repartition(3)


@pytest.fixture(scope="module")
def tk():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=60).map("".join) | st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_codec_is_tiktoken(tk, text):
    codec = bpe.text_codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = [i for part in codec.encode(text) for i in part]
    assert ids == tk.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_codec_long_runs(tk):
    codec = bpe.text_codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for c in "ab -":
        assert [i for part in codec.encode(c * 20000) for i in part] == tk.encode_ordinary(c * 20000)


def test_op1(spark, docs, tk):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = bpe.codec_digests(docs, *args)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id] or ""
            ids = tk.encode_ordinary(text)
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, *args), *args).collect()
    assert {r.doc_id: bytes(r.bytes) for r in back if r.doc_id is not None} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.codec_digests(docs.limit(0), *args).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_library_encoder(name):
    enc = tokens.word_encoder(P.path(name)) if "word" in name else tokens.piece_encoder(P.path(name))
    want = library(name)
    texts = [t or "" for t in TEXTS] + ["".join(chr(random.Random(i).randint(1, 0x2FFF)) for _ in range(30)) for i in range(500)]
    spaced = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "b.", "'s", "'", "\u2003", "é", "1", ",,", ".", ",", "The", "STR"]
    texts += ["".join(random.Random(i).choice(spaced) for _ in range(12)) for i in range(3000)]
    flat, ends = enc.encode(texts, 7)
    for text, ids in zip(texts, np.split(flat, ends[:-1])):
        assert ids.tolist() == [*want(text), 7], ascii(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=pfor.BLOCK))
def test_block_round_trip(values):
    x = np.array(values, np.uint32)
    assert pfor.unpack_block(pfor.pack_block(x)).tolist() == values


def test_shard_ranges():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50000, n).astype(np.uint32) for n in (0, 1, 5000, 3, 1024, 2048)]
    s = pfor.Shard(pfor.write_shard([5, None, -3, 2**62, 0, 1], ids))
    every = np.concatenate(ids)
    assert s.doc_ids == [5, None, -3, 2**62, 0, 1]
    assert s.lengths.tolist() == [len(x) for x in ids]
    for a, b in ((0, 0), (0, len(every)), (1023, 1025), (5000, 5001), (2048, 4096)):
        assert s.ids(a, b).tolist() == every[a:b].tolist()


def test_op7(spark, docs, monkeypatch):
    want = library("word_bpe_49k.json")
    rows = pfor.read_ids(pfor.write_ids(docs, P.path("word_bpe_49k.json"), 2, Scratch(spark))).collect()
    assert len(rows) == len(TEXTS) + 2
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in rows:
        ids = [*want("no id" if r.doc_id is None else TEXTS[r.doc_id]), 2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert pfor.read_ids(pfor.write_ids(docs.limit(0), P.path("word_bpe_49k.json"), 2, Scratch(spark))).count() == 0


def test_op9(spark, docs):
    want = library("byte_bpe_50k.json")
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), 1, Scratch(spark), with_ids=True)
    rows = pieces.collect()
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at = 0
    total = sum(len(want(t)) + 1 for t in TEXTS) + len(want("no id")) + 1 + len(want("the")) + 1
    for r in rows:
        assert r.sequence_id * 2048 + r.offset == at and 0 < r.length <= 2048 - r.offset
        at += r.length
        ids = [*want("no id" if r.doc_id is None else TEXTS[r.doc_id]), 1]
        assert r.doc_tokens == len(ids)
        assert r.ids == ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert at == total
    whole = packing.sequences(pieces, pad_id=9).collect()
    assert {len(r.ids) for r in whole} == {2048} and len(whole) == -(-total // 2048)
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json"), 1, Scratch(spark)).count() == 0


def test_op10(spark, monkeypatch):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "b.example.org", "/es/x")]
    hosts = ["org", "example.org", "a.Example.ORG", "xexample.org", "b.example.org", "com", "a.com", "coma", "net", "", "a..com", "b.a.b.example.org"]
    paths = ["", "/", "/es/", "/es", "/es/x?q=1", "/en/12#z", "/fr/", "/de/x", "?/de/", "#", "/De/"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "org/", "http:/org/", "x://y://org/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, urls[5], "r")], "page_id long, url string, rule string").repartition(3)

    def brute(u):
        i = (u or "").find("://")
        rest = u[i + 3 :] if i >= 0 else ""
        cut = min([j for j in map(rest.find, "/?#") if j >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    def check():
        rows = url_rules.judge(df, rules).collect()
        assert len(rows) == len(urls) + 1
        for r in rows:
            u = urls[5] if r.page_id is None else urls[r.page_id]
            assert (r.host, r.path, r.rule, r.verdict) == brute(u), u

    check()
    monkeypatch.setattr(url_rules, "RULES_AT_ONCE", 2)
    check()
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(df, []).collect()} == {"allow"}
