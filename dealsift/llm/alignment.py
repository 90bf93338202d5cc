"""Alignment of two tokenizers over the bytes of the same text, by sparse incidence matrices.

Row i of A holds the bytes that token i of the first tokenizer covers, row k of B those of the second. Both are built by
hand as compressed rows (``Rows``). The product A·Bᵀ by Gustavson's rows (``product``: the rows of Bᵀ that a row of A
points to are joined and equal columns summed) has an entry for each pair of tokens whose bytes overlap, with the number of
shared bytes: the overlap links. Bytes where tokens of both end cut a text into groups; with the token-group incidences G
and H the product G·Hᵀ gives the pairs that share a group. Such a product can be far larger than the text, so it is only
made in blocks of rows, and its size follows from the row sizes alone (``product_sizes``).

How often an id pair is linked is counted over all documents: links are merged within a document, then within a task,
then by Spark. Documents meet the counts in a join on the pair; the counts are broadcast only below ``BROADCAST_PAIRS``
rows, beyond that both sides are shuffled and adaptive execution splits pairs that nearly every document has. The aligned
documents are written once to the shared folder, so texts are encoded once.

The text is read as blank + text. The first tokenizer is a file of the tokenizers library with byte-level tokens, the
second a sentencepiece model that adds this blank itself and has pieces with U+2581 (a blank) only in front. A piece never
spans the place before a blank, so units between such places are encoded once for all texts of a slice.

Defined cases: null and empty texts, and texts whose joined tokens of one side are not the bytes of blank + text (U+2581
in the text), have no tokens: zeros and an empty digest. Null ids and repeated rows are kept and counted each; extra
columns are left out. A text above a slice is aligned piece by piece, cut where a blank follows another character: there
tokens of both sides end, so a group does.
"""

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dealsift.llm import textkit as T, tokens
from dealsift.llm.tables import documents, stored

#: Text bytes aligned at a time, entries of a product made at a time, and counted pairs that may be broadcast.
SLICE_BYTES, BLOCK_ENTRIES, BROADCAST_PAIRS = 1 << 20, 1 << 20, 2_000_000
#: An id pair is one number: the first id in front of 32 bits for the second.
SECOND = np.int64(1) << np.int64(32)


class Rows(NamedTuple):
    """A sparse matrix of ones in compressed rows: bounds of the rows, column of each entry, number of columns."""

    bounds: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> "Rows":
        order = np.argsort(self.columns, kind="stable")
        sizes = np.bincount(self.columns, minlength=self.width)
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), owner[order], len(self.bounds) - 1)


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Entries each row of a·b joins, before equal columns are summed."""
    sizes = np.concatenate([[0], np.cumsum(np.diff(b.bounds)[a.columns])])
    return np.diff(sizes[a.bounds])


def product(a: Rows, b: Rows, most: int = BLOCK_ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and value of every entry of a·b, in blocks of whole rows that join about ``most`` entries."""
    work = np.cumsum(product_sizes(a, b))
    at, n = 0, len(a.bounds) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + most, side="right")))
        picks = a.columns[a.bounds[at]:a.bounds[stop]]
        where, ends = T.gather(b.bounds, picks)
        row = np.repeat(np.repeat(np.arange(at, stop), np.diff(a.bounds[at:stop + 1])), np.diff(ends))
        key = row * b.width + b.columns[where]
        if len(key) and (key[1:] < key[:-1]).any():
            key.sort(kind="stable")
        first = np.flatnonzero(np.diff(key, prepend=-1))
        yield key[first] // b.width, key[first] % b.width, np.diff(first, append=len(key))
        at = stop


class ByteIds:
    """First side: ids of a tokenizers file, special strings as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = tokens.Library(path)
        self.encoder.tokenizer.encode_special_tokens = True
        self.special = self.encoder.special = []
        byte_of = {s: b for b, s in tokens.byte_signs().items()}
        vocab = self.encoder.tokenizer.get_vocab(with_added_tokens=False)
        raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw[i] = bytes(byte_of[s] for s in token) if all(s in byte_of for s in token) else token.encode()
        self.raw = raw

    def encode(self, units: list[str]) -> list[bytes]:
        return self.encoder.encode(units)


class PieceIds:
    """Second side: ids of a sentencepiece model, which puts a blank in front of a text, and the bytes of each id."""

    special: list[str] = []

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a blank behind another character")
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = np.array([self.model.piece_to_id("▁")], "<u4").tobytes()
        self.known = tokens.Memory()

    def encode(self, units: list[str]) -> list[bytes]:
        """Each unit begins with the blank that the model would add; the model gives nothing for a blank alone."""
        self.known.renew()
        out = [self.blank if u == " " else self.known.get(u) for u in units]
        new = [i for i, found in enumerate(out) if found is None]
        for i, ids in zip(new, self.model.encode([units[i][1:] for i in new], num_threads=1)):
            out[i] = np.array(ids, "<u4").tobytes()
            self.known.keep(units[i], out[i])
        return out


class Side(NamedTuple):
    """One tokenizer in a worker: its encoder, bytes of each id, and each id in decimal with one byte more for a mark."""

    encoder: ByteIds | PieceIds
    sizes: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    decimal_offsets: np.ndarray
    decimals: np.ndarray


def _ragged(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64), np.frombuffer(b"".join(values), np.uint8)


_SIDES: dict[str, Side] = {}


def side(path: str) -> Side:
    if path not in _SIDES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = PieceIds(path) if path.endswith(".model") else ByteIds(path)
        offsets, data = _ragged(encoder.raw)
        _SIDES[path] = Side(encoder, np.diff(offsets), offsets, data, *_ragged([b"%d " % i for i in range(len(encoder.raw))]))
    return _SIDES[path]


def blank_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Every text's first byte and every blank (U+0020 only) behind another character."""
    first = np.zeros(len(data), dtype=bool)
    blank = data == 32
    first[1:] = blank[1:] & ~blank[:-1]
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(first)


def piece_ids(texts: pa.Array, encoder: PieceIds) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = T.flat(texts)
    starts = blank_starts(data, bounds)
    offsets = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    found = encoder.encode(units.dictionary.to_pylist())
    return tokens.spread(units.indices.to_numpy(zero_copy_only=False), found, np.searchsorted(starts, bounds))


def _ids(texts: pa.Array, one: Side) -> tuple[np.ndarray, np.ndarray]:
    return piece_ids(texts, one.encoder) if isinstance(one.encoder, PieceIds) else tokens.encode(texts, one.encoder)


def _same(one: Side, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, text_bounds: np.ndarray) -> np.ndarray:
    """Whether each text's joined tokens are its bytes."""
    at, ends = T.gather(one.offsets, ids.astype(np.int64))
    cuts = ends[bounds]
    same = np.diff(cuts) == np.diff(text_bounds)
    if same.all():
        wrong = np.flatnonzero(one.data[at] != data)
        same[T.owner(text_bounds, wrong)] = False
        return same
    joined = one.data[at]
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(joined[cuts[i]:cuts[i + 1]], data[text_bounds[i]:text_bounds[i + 1]])
    return same


class Aligned(NamedTuple):
    """Tokens, groups and incidences of the texts of a slice, one behind the other; texts without tokens are empty."""

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    group_bounds: np.ndarray
    a_bytes: Rows
    b_bytes: Rows
    a_groups: Rows
    b_groups: Rows
    group_ends: np.ndarray
    text_bounds: np.ndarray


def _incidence(ends: np.ndarray, width: int) -> Rows:
    """Which bytes each token covers, from the end bytes of the tokens."""
    return Rows(np.concatenate([[0], ends]), np.arange(width), width)


def with_blank(texts: pa.Array) -> pa.Array:
    """blank + text; null and empty texts stay empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    none, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(none, texts, blank))


def align(texts: pa.Array, first: Side, second: Side) -> Aligned:
    """Alignment of texts that begin with a blank or are empty."""
    data, text_bounds = T.flat(texts)
    (a, a_bounds), (b, b_bounds) = _ids(texts, first), _ids(texts, second)
    good = _same(first, a, a_bounds, data, text_bounds) & _same(second, b, b_bounds, data, text_bounds)
    if not good.all():
        a, b = a[np.repeat(good, np.diff(a_bounds))], b[np.repeat(good, np.diff(b_bounds))]
        a_bounds, b_bounds, text_bounds = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(x), 0))]) for x in (a_bounds, b_bounds, text_bounds))
    width = int(text_bounds[-1])
    a_ends, b_ends = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    groups = [Rows(np.arange(len(ends) + 1), np.searchsorted(shared, ends), len(shared)) for ends in (a_ends, b_ends)]
    return Aligned(a, b, a_bounds, b_bounds, np.searchsorted(shared, text_bounds, side="right"), _incidence(a_ends, width), _incidence(b_ends, width), *groups, shared, text_bounds)


class Base(NamedTuple):
    """What lies in a long text before the piece at hand."""

    a: int = 0
    b: int = 0
    groups: int = 0
    bytes: int = 0


def pieces(text: bytes, limit: int) -> list[bytes]:
    """A text that begins with a blank in pieces of about ``limit`` bytes that begin with one as well."""
    places = np.append(blank_starts(np.frombuffer(text, np.uint8), np.array([0, len(text)])), len(text))
    cuts = [0]
    while cuts[-1] < len(text):
        at = int(np.searchsorted(places, cuts[-1] + limit, side="right")) - 1
        cuts.append(int(places[at if places[at] > cuts[-1] else at + 1]))
    return [text[x:y] for x, y in zip(cuts[:-1], cuts[1:])]


def alignments(batches, first: Side, second: Side, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Aligned, Base]]:
    """Rows and their alignment, slice by slice; a longer text comes as one row several times, each time with the next piece."""
    for batch in batches:
        for part in T.slices(batch, limit=limit):
            texts = with_blank(part.column("text"))
            if len(part) > 1 or pc.binary_length(texts)[0].as_py() <= limit:
                yield part, align(texts, first, second), Base()
                continue
            cut = [pa.array([p.decode()], pa.large_string()) for p in pieces(texts[0].as_py().encode(), limit)]
            if not all(len(align(p, first, second).a) for p in cut):  # one side does not give the bytes of the text
                yield part, align(pa.array([""], pa.large_string()), first, second), Base()
                continue
            base = Base()
            for p in cut:
                found = align(p, first, second)
                yield part, found, base
                base = Base(base.a + len(found.a), base.b + len(found.b), base.groups + len(found.group_ends), base.bytes + int(found.text_bounds[-1]))


def group_text(found: Aligned, first: Side, second: Side) -> tuple[memoryview, list[int]]:
    """``a1,a2|b1;a3|b2,b3;`` of all texts in a row, and the bounds of each text."""
    n_a, n_b = len(found.a), len(found.b)
    group = np.concatenate([found.a_groups.columns, found.b_groups.columns])
    order = np.argsort(group, kind="stable")  # within a group the first side's tokens, then the second's
    group, from_b = group[order], order >= n_a
    last = np.ones(n_a + n_b, dtype=bool)
    last[:-1] = (group[1:] != group[:-1]) | (from_b[1:] != from_b[:-1])
    marks = np.where(~last, ord(","), np.where(from_b, ord(";"), ord("|"))).astype(np.uint8)
    offsets = np.concatenate([first.decimal_offsets, second.decimal_offsets[1:] + first.decimal_offsets[-1]])
    decimals = np.concatenate([first.decimals, second.decimals])
    at, ends = T.gather(offsets, np.concatenate([found.a.astype(np.int64), found.b.astype(np.int64) + len(first.sizes)])[order])
    text = decimals[at]
    text[ends[1:] - 1] = marks
    return memoryview(text).cast("B"), ends[found.a_bounds + found.b_bounds].tolist()


def linked_pairs(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Text and id pair of every overlap link."""
    text_of, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, k, _ in product(found.a_bytes, found.b_bytes.transposed()):
        text_of.append(T.owner(found.a_bounds, i))
        keys.append(found.a[i].astype(np.int64) * SECOND + found.b[k])
    return np.concatenate(text_of), np.concatenate(keys)


def merged(text_of: np.ndarray, keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of a text once, with their times."""
    order = np.lexsort((keys, text_of))
    keys, text_of = keys[order], text_of[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text_of[1:] != text_of[:-1])
    start = np.flatnonzero(new)
    return text_of[start], keys[start], np.diff(start, append=len(keys)) if times is None or not len(keys) else np.add.reduceat(times[order], start)


class _Long:
    """Figures of a long text, piece by piece."""

    def __init__(self):
        self.sums, self.pairs, self.sha = 0, (np.zeros(0, np.int64),) * 3, hashlib.sha256()

    def add(self, sums: np.ndarray, pairs: tuple, text: memoryview) -> None:
        self.sha.update(text[:-1] if isinstance(self.sums, int) else b";" + bytes(text[:-1]))
        self.sums = self.sums + sums
        self.pairs = merged(*(np.concatenate(x) for x in zip(self.pairs, pairs)))


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def _rows(doc_ids, figures: np.ndarray, digests: list[str], pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    bounds = pa.array(np.searchsorted(pairs[0], np.arange(len(digests) + 1)), pa.int32())
    return pa.RecordBatch.from_pydict({
        "doc_id": doc_ids, **{n: pa.array(v, pa.int64()) for n, v in zip(FIGURES, figures)}, "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(bounds, pa.array(pairs[1], pa.int64())), "times": pa.ListArray.from_arrays(bounds, pa.array(pairs[2], pa.int32()))})


def aligned(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each document: row, doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, and its linked id pairs with their times.

    ``row`` tells rows that share an id apart; store the result before it is used twice.
    """
    def run(batches):
        first, second = side(a_path), side(b_path)
        long, ids = None, None
        for part, found, base in alignments(batches, first, second, slice_bytes):
            if long and not base.bytes:
                yield _rows(ids, long.sums, [long.sha.hexdigest()], long.pairs)
                long = None
            text_of, keys = linked_pairs(found)
            shared = np.concatenate([[0], np.cumsum(product_sizes(found.a_groups, found.b_groups.transposed()))])
            figures = np.array([np.diff(found.a_bounds), np.diff(found.b_bounds), np.diff(found.group_bounds), np.bincount(text_of, minlength=len(part)), np.diff(shared[found.a_bounds])])
            pairs, (text, cuts) = merged(text_of, keys), group_text(found, first, second)
            if len(part) == 1 and len(found.a):
                long, ids = long or _Long(), part.column("doc_id")
                long.add(figures, pairs, text)
            else:
                yield _rows(part.column("doc_id"), figures, [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1], cuts[1:])], pairs)
        if long:
            yield _rows(ids, long.sums, [long.sha.hexdigest()], long.pairs)

    rows = documents(docs).mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in FIGURES)}, groups_sha256 string, pairs array<long>, times array<int>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links that hold it, over all documents) and best (whether n is the highest of its second id)."""
    def run(batches):
        for batch in batches:
            pairs, at = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            times = np.bincount(at, batch.column("times").flatten().to_numpy(zero_copy_only=False), minlength=len(pairs))
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "n": pa.array(times.astype(np.int64), pa.int64())})

    counts = rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts, "alignment-counts")
    second = F.col("pair").bitwiseAND(F.lit(int(SECOND) - 1))
    highest = counts.groupBy(second.alias("b_id")).agg(F.max("n").alias("most"))  # a row for each second id: bounded by its vocabulary
    return counts.join(F.broadcast(highest), second == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summary(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_group_links of every row."""
    rows = stored(aligned(docs, a_path, b_path, slice_bytes), "alignment")
    counts = pair_counts(rows)
    small = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    met = links.join(F.broadcast(counts) if small else counts.hint("merge"), "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "n_group_links")


def links(docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Each link as a row: doc_id, a_at and b_at (places of the tokens in their text), a_id, b_id and weight.

    ``overlap``: pairs of tokens that share bytes, weight is their number. ``group``: pairs in one group, weight 1. Blocks of a
    product leave the task as they are made.
    """
    if kind not in ("overlap", "group"):
        raise ValueError("kind is overlap or group")

    def run(batches):
        first, second = side(a_path), side(b_path)
        for part, found, base in alignments(batches, first, second, slice_bytes):
            left, right = (found.a_bytes, found.b_bytes) if kind == "overlap" else (found.a_groups, found.b_groups)
            for i, k, weight in product(left, right.transposed()):
                text = T.owner(found.a_bounds, i)
                values = (i - found.a_bounds[text] + base.a, k - found.b_bounds[text] + base.b, found.a[i], found.b[k], weight)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(text)), **{n: pa.array(v.astype(np.int64)) for n, v in zip(("a_at", "b_at", "a_id", "b_id", "weight"), values)}})

    return documents(docs).mapInArrow(run, "doc_id long, a_at long, b_at long, a_id long, b_id long, weight long")


def groups(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Each group as a row: doc_id, group (its number in the text), end_byte (in blank + text), a_ids and b_ids."""
    def run(batches):
        first, second = side(a_path), side(b_path)
        for part, found, base in alignments(batches, first, second, slice_bytes):
            number = np.arange(len(found.group_ends))
            text = T.owner(found.group_bounds, number)
            lists = {n: pa.ListArray.from_arrays(pa.array(np.searchsorted(rows.columns, np.arange(len(number) + 1)), pa.int32()), pa.array(ids.astype(np.int32)))
                     for n, rows, ids in (("a_ids", found.a_groups, found.a), ("b_ids", found.b_groups, found.b))}
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(pa.array(text)), "group": pa.array(number - found.group_bounds[text] + base.groups, pa.int64()),
                "end_byte": pa.array(found.group_ends - found.text_bounds[text] + base.bytes, pa.int64()), **lists})

    return documents(docs).mapInArrow(run, "doc_id long, group long, end_byte long, a_ids array<int>, b_ids array<int>")
