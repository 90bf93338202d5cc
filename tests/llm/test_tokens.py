"""Token counts, byte-pair encoding and the token store against the tokenizers library."""

import functools
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cases import frame, texts
from dealsift.llm import bpe, token_counts, token_store, tokens
from dealsift.llm.catalog import tokenizer

BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


loaded = functools.lru_cache(Tokenizer.from_file)


def ids_of(path, some):
    return [e.ids for e in loaded(path).encode_batch([t or "" for t in some], add_special_tokens=False)]


@pytest.fixture(scope="module")
def expected():
    return list(zip(texts(), ids_of(BYTE, [t for _, t in texts()])))


@pytest.mark.parametrize("slice_bytes", [1 << 22, 500])
def test_counts(spark, documents, expected, slice_bytes):
    got = sorted(map(tuple, token_counts.count(documents, BYTE, slice_bytes=slice_bytes).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(ids), len(ids) > 1024) for (i, t), ids in expected), key=str)


def test_round_trip_digests(spark, documents, expected):
    got = sorted(map(tuple, bpe.round_trip(documents, BYTE).collect()), key=str)
    assert got == sorted(((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                          for (i, t), ids in expected), key=str)


def test_encode_then_decode(spark, documents):
    again = bpe.decode(bpe.encode(documents, BYTE), BYTE)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(((i, t or "") for i, t in texts()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sab.,!12é\u00a0\u2003\x1c<|>"), st.characters(codec="utf-8")), max_size=60), max_size=8))
def test_any_text(some):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(some, pa.string())})
    own = [ids[a:b].tolist() for _, ids, cut in bpe.encoded([batch], BYTE) for a, b in zip(cut[:-1], cut[1:])]
    assert own == ids_of(BYTE, some)
    for path in (BYTE, WORD):
        ids, cut = tokens.encode(batch.column("text"), tokens.library(path))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == ids_of(path, some)


def test_pieces_of_a_long_text():
    text = ("word  and\n\nline " * 400).encode()
    pieces = tokens.cut_long(text, 100)
    assert b"".join(pieces) == text and max(map(len, pieces)) <= 100 and len(pieces) > 50
    assert tokens.cut_long(b"x" * 1000, 100) == [b"x" * 1000]


def test_other_blanks_and_special_strings_bind_only_their_neighbourhood():
    text = "mots \u00a0; il dit\u00a0: <|endoftext|> et\u2003  rien. " * 400
    pieces = tokens.cut_long(text.encode(), 200, ["<|endoftext|>"])
    assert b"".join(pieces) == text.encode() and max(map(len, pieces)) <= 200
    assert sum(ids_of(BYTE, [p.decode() for p in pieces]), []) == ids_of(BYTE, [text])[0]
    enc = tokens.Library(BYTE)
    ids, _ = tokens.encode(pa.array([f"{text} {i}" for i in range(50)]), enc)
    assert len(ids) and len(enc.known) < 100 and enc.known.held < 30_000


def test_memory_is_bounded_in_bytes_and_keeps_no_long_unit():
    enc = tokens.Library(BYTE)
    enc.known.limit = 10_000
    for i in range(30):
        tokens.encode(pa.array([f"word{'abcdefghij'[i % 10] * (i + 1)} n{i} " * 20 + "x" * 70 + str(i)]), enc)
    assert enc.known.held < 20_000 and max(map(len, enc.known), default=0) <= tokens.SHORT
    words = bpe.Encoder(BYTE)
    words.units.limit = words.words.limit = 5_000
    for i in range(30):
        found = words.learn([f" w{i}{j}" for j in range(20)] + ["y" * 100 + str(i)])
        assert all(np.frombuffer(v, "<u4").tolist() == ids for v, ids in zip(found.values(), ids_of(BYTE, list(found))))
    assert words.units.held < 12_000 and max(map(len, words.words)) <= tokens.SHORT


def test_store(spark, documents, tmp_path):
    token_store.write(documents, WORD, str(tmp_path / "s"))
    got = sorted(map(tuple, token_store.read(spark, str(tmp_path / "s"), digest=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in got if r[0] is not None] == sorted(i for i, _ in texts() if i is not None) and got[-1][0] is None
    found = ids_of(WORD, [t for _, t in texts()])
    expected = sorted((str(i), zlib.crc32(np.array([*ids, 2], "<u4").tobytes()), len(ids) + 1) for (i, _), ids in zip(texts(), found))
    assert sorted((str(i), crc, n) for i, _, n, crc in got) == expected
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    whole = {(r.doc_id, r.start): r.ids for r in token_store.read(spark, str(tmp_path / "s")).collect()}
    assert all(zlib.crc32(np.array(whole[i, s], "<u4").tobytes()) == crc for i, s, _, crc in got)


def test_store_of_nothing(spark, tmp_path):
    token_store.write(frame(spark, []), WORD, str(tmp_path / "e"))
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300))
def test_code_lengths_are_best_and_limited(counts):
    counts = np.array(counts)
    lengths = token_store.code_lengths(counts, 12)
    used = counts > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= 12
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
        heap, cost = [int(c) for c in counts[used]], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert (token_store.code_lengths(counts, 40)[used].astype(int) * counts[used]).sum() == cost


def test_shard_round_trip():
    pick = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.minimum(pick.geometric(0.01, n), 3000).astype(np.uint32)
        lengths = token_store.code_lengths(np.bincount(ids, minlength=3001) + (np.arange(3001) == 7))
        body = token_store.pack(ids, np.array([5, 6]), np.array([False, True]), np.array([n, 0]), lengths, token_store.canonical(lengths))
        back, docs, null, sizes = token_store.unpack(body, token_store.decoding_table(lengths))
        assert (back == ids).all() and docs.tolist() == [5, 6] and null.tolist() == [0, 1] and sizes.tolist() == [n, 0]
