"""Rank-table encoding, fill-in-the-middle and alignment against the libraries and plain versions."""

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Regex, Tokenizer, pre_tokenizers

from cases import frame, texts
from dealsift.llm import alignment, fill_middle, rank_bpe, tokens
from dealsift.llm.catalog import tokenizer

RANKS, BYTE, PIECE = tokenizer("byte_bpe_multi_50k.tiktoken"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
ANY = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sab.,!12é  \x1c<|>▁x日🙂"), st.characters(codec="utf-8")), max_size=60)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# rank table

@functools.cache
def own():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=rank_bpe.read_ranks(RANKS), special_tokens={})


@functools.cache
def spec():
    return rank_bpe.tokenizer_json(RANKS, PATTERN)


def test_both_libraries_know_the_same_classes_of_characters():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for one in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding("one", pat_str=one, mergeable_ranks=single, special_tokens={})
        rest = {c for piece, _ in pre_tokenizers.Split(Regex(one), "removed").pre_tokenize_str(every) for c in piece}
        assert set(theirs.decode(theirs.encode_ordinary(every))) == set(every) - rest


def test_each_token_of_the_rank_table_is_reached_by_one_merge():
    ranks = rank_bpe.read_ranks(RANKS)
    merges = rank_bpe.merge_list(ranks)
    assert len(merges) == len(ranks) - 256 and sorted(ranks[a + b] for a, b in merges) == list(range(256, len(ranks)))


@settings(max_examples=300, deadline=None)
@given(st.lists(ANY, max_size=8))
def test_ids_are_those_of_the_rank_library(some):
    ids, cut = tokens.encode(pa.array(some, pa.string()), rank_bpe.encoder(spec()))
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [own().encode_ordinary(t) for t in some]
    raw, ends = rank_bpe.encoder(spec()).decode(ids, cut)
    assert [raw.tobytes()[a:b].decode() for a, b in zip(ends[:-1], ends[1:])] == some


def test_made_up_ranks_with_ties_and_unreached_tokens():
    pick = random.Random(3)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(80):  # runs and mirrored strings, many of them out of reach of merges
        ranks.setdefault(bytes(pick.choice(b"ab") for _ in range(pick.randrange(2, 8))), len(ranks))
    theirs = tiktoken.Encoding("made", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    merges = rank_bpe.merge_list(ranks)
    assert len(merges) < len(ranks) - 256
    signs = tokens.byte_signs()
    write = lambda t: "".join(map(signs.get, t))
    from tokenizers.models import BPE

    model = BPE(vocab={write(t): r for t, r in ranks.items()}, merges=[(write(a), write(b)) for a, b in merges], ignore_merges=True)
    for _ in range(5000):
        word = "".join(pick.choice("ab") for _ in range(pick.randrange(1, 30)))
        assert [t.id for t in model.tokenize(word)] == theirs.encode_ordinary(word)


def test_rank_round_trip(spark, documents):
    got = sorted(map(tuple, rank_bpe.round_trip(documents, RANKS, PATTERN).collect()), key=str)
    assert got == sorted(((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
                          for i, t in texts() for ids in [own().encode_ordinary(t or "")]), key=str)


def test_rank_long_text_in_pieces():
    text = "mot : <|endoftext|> n'est  pas 12\n" * 300 + "x" * 3000
    ids, cut = tokens.encode_slice(pa.array([text]), rank_bpe.encoder(spec()), 500)
    assert ids.tolist() == own().encode_ordinary(text) and cut.tolist() == [0, len(ids)]


def test_offsets_and_split_characters(spark, documents):
    library = Tokenizer.from_str(spec())
    rows = {(r.doc_id, tuple(r.ids)): r for r in rank_bpe.encode(documents, RANKS, PATTERN, offsets=True).collect()}
    split = 0
    for i, t in texts():
        e = library.encode(t or "", add_special_tokens=False)
        r = rows[i, tuple(e.ids)]
        assert list(zip(r.first_char, r.end_char)) == e.offsets
        raw = (t or "").encode()
        parts = [raw[a:b] for a, b in zip(r.first_byte, r.end_byte)]
        assert b"".join(parts) == raw and parts == own().decode_tokens_bytes(r.ids)
        split += not all(map(_whole, parts))
    assert split
    again = rank_bpe.decode(rank_bpe.encode(documents, RANKS, PATTERN), RANKS, PATTERN, pieces=True).collect()
    assert sorted(((r.doc_id, r.text) for r in again), key=str) == sorted(((i, t or "") for i, t in texts()), key=str)
    assert all("".join(r.pieces) == r.text and bytes(r.raw) == r.text.encode() for r in again)
    assert rank_bpe.token_texts(["🙂".encode()[:2], "🙂".encode()[2:] + b"a", b"\xff", b"\xe6"]) == ["", "🙂a", "�", "�"]


def _whole(part: bytes) -> bool:
    try:
        part.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_decode_of_nulls_and_of_ids_beyond_the_table(spark):
    rows = spark.createDataFrame([(1, None), (None, []), (3, [0, 1])], "doc_id long, ids array<int>")
    assert {(r.doc_id, bytes(r.raw)) for r in rank_bpe.decode(rows, RANKS, PATTERN).collect()} == {(1, b""), (None, b""), (3, own().decode_bytes([0, 1]))}
    with pytest.raises(ValueError):
        rank_bpe.encoder(spec()).decode(np.array([50_256]), np.array([0, 1]))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert rank_bpe.round_trip(none, RANKS, PATTERN).count() == 0
    assert fill_middle.digests(none).count() == 0
    assert alignment.summary(none, BYTE, PIECE).count() == 0


# fill-in-the-middle

def plain_cut(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = [m[0] for m in regex.finditer(fill_middle.LINES, text)]
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def lines():
    made = texts() + [(300 + i, "\n".join(t.split(" ")[:20]) + "\n" * (i % 3)) for i, (_, t) in enumerate(texts()[-30:])]
    return made + [(400, "a\n<P>b"), (401, "<\n<S\n<P\nS>\n<"), (402, "\n\n\n"), (403, "\r\nx y\x0bz\n日本\n🙂"), (None, "a\nb"), (404, "a\nb\n"), (404, "a\nb\n")]


@pytest.mark.parametrize("options", [{}, {"seed": 11, "percent": 60, "spm_percent": 20}])
def test_fill_middle(spark, options):
    cut = fill_middle.transform(frame(spark, lines()), **options)
    got = sorted(map(tuple, cut.collect()), key=str)
    assert got == sorted((plain_cut(i, t, *([11, 60, 20] if options else [])) for i, t in lines()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    again = cut.select("doc_id", fill_middle.restore().alias("text"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(((i, t or "") for i, t in lines()), key=str)


def test_units_beyond_one_match():
    text = "ab\n\nc" * 1000
    ends = list(fill_middle.unit_ends(fill_middle.unit_pattern(fill_middle.LINES), text))
    assert ends == list(fill_middle.unit_ends(fill_middle.unit_pattern(fill_middle.LINES, 7), text)) == [m.end() for m in regex.finditer(fill_middle.LINES, text)]
    with pytest.raises(ValueError):
        fill_middle.unit_ends(fill_middle.unit_pattern(r"\d"), "12a")


# alignment

@functools.cache
def sides():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte_of = {s: n for n, s in tokens.byte_signs().items()}
    a_bytes = lambda i: bytes(byte_of[s] for s in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def plain_alignment(text):
    """Tokens, groups and overlap links of one text, token by token."""
    a, b, a_bytes, b_bytes = sides()
    if not text:
        return [], [], [], []
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(a_bytes, left)) != whole or b"".join(map(b_bytes, right)) != whole:
        return [], [], [], []
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for ids, f in ((left, a_bytes), (right, b_bytes))]
    shared = sorted(set(ends[0]) & set(ends[1]))
    number = {e: n for n, e in enumerate(shared)}
    groups, at = [([], []) for _ in shared], [0, 0]
    for which, ids in enumerate((left, right)):
        for i, e in zip(ids, ends[which]):
            groups[at[which]][which].append(i)
            at[which] = number[e] + 1 if e in number else at[which]
    linked, k = [], 0
    starts = [[0, *e[:-1]] for e in ends]
    for i in range(len(left)):
        while ends[1][k] <= starts[0][i]:
            k += 1
        j = k
        while j < len(right) and starts[1][j] < ends[0][i]:
            linked.append((i, j, left[i], right[j], min(ends[0][i], ends[1][j]) - max(starts[0][i], starts[1][j])))
            j += 1
    return left, right, groups, linked


def plain_summary(rows):
    found = [(i, plain_alignment(t)) for i, t in rows]
    counts = Counter((x[2], x[3]) for _, (_, _, _, linked) in found for x in linked)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    for i, (left, right, groups, linked) in found:
        n = [counts[x[2], x[3]] for x in linked]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield (i, len(left), len(right), len(groups), len(linked), sum(c == most[x[3]] for c, x in zip(n, linked)), sum(n), sha(text.encode()) if left else "",
               sum(len(x) * len(y) for x, y in groups))


def odd_texts():
    return texts() + [(500, "a▁b"), (501, " "), (502, "  two  blanks  "), (503, "\n\ttabs\r\n"), (504, "naïve café 日本語 🙂🙂 \x00 end"), (505, "<s> <unk> <0x41> </s>"), (506, "z" * 700), (507, "long " * 900)]


@pytest.mark.parametrize("limit,slice_bytes", [(2_000_000, 1 << 20), (0, 600)])
def test_alignment_summary(spark, limit, slice_bytes):
    got = alignment.summary(frame(spark, odd_texts()), BYTE, PIECE, broadcast_pairs=limit, slice_bytes=slice_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_summary(odd_texts()), key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 600])
def test_links_and_groups(spark, slice_bytes):
    rows = [(k, t) for k, (_, t) in enumerate(odd_texts()) if t is None or len(t) < 2_000][-45:]
    docs = frame(spark, rows)
    expected = {i: plain_alignment(t) for i, t in rows}
    got = sorted(map(tuple, alignment.links(docs, BYTE, PIECE, slice_bytes=slice_bytes).collect()))
    assert got == sorted((i, *x) for i, (_, _, _, linked) in expected.items() for x in linked)
    shared = sorted(map(tuple, alignment.links(docs, BYTE, PIECE, kind="group", slice_bytes=slice_bytes).collect()))
    again = sorted((i, a, b) for i, a, b in _in_groups(expected))
    assert [r[:3] for r in shared] == again and all(r[5] == 1 for r in shared)
    found = sorted((r.doc_id, r.group, tuple(r.a_ids), tuple(r.b_ids)) for r in alignment.groups(docs, BYTE, PIECE, slice_bytes=slice_bytes).collect())
    assert found == sorted((i, g, tuple(x), tuple(y)) for i, (_, _, groups, _) in expected.items() for g, (x, y) in enumerate(groups))


def _in_groups(expected):
    for i, (_, _, groups, _) in expected.items():
        a = b = 0
        for x, y in groups:
            yield from ((i, a + m, b + n) for m in range(len(x)) for n in range(len(y)))
            a, b = a + len(x), b + len(y)


@settings(max_examples=200, deadline=None)
@given(st.lists(ANY, max_size=5))
def test_piece_units_give_the_ids_of_the_text(some):
    one = alignment.side(PIECE)
    ids, cut = alignment.piece_ids(alignment.with_blank(pa.array(some, pa.string())), one.encoder)
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [sides()[1].encode(t) for t in some]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6), st.integers(1, 9))
def test_product_of_sparse_matrices(n, m, k, seed, most):
    pick = np.random.default_rng(seed)
    left, right = pick.random((n, m)) < 0.4, pick.random((k, m)) < 0.4

    def rows(x):
        return alignment.Rows(np.concatenate([[0], np.cumsum(x.sum(1))]), np.nonzero(x)[1], x.shape[1])

    out = np.zeros((n, k), int)
    for i, j, value in alignment.product(rows(left), rows(right).transposed(), most):
        out[i, j] += value
    assert (out == left.astype(int) @ right.T.astype(int)).all()
    assert alignment.product_sizes(rows(left), rows(right).transposed()).sum() == out.sum()
