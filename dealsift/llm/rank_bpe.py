"""Byte-level BPE from a table of ranks, by the tokenizers library over Arrow batches.

A rank file lists byte strings by rank and no merges. A merge list that gives the same ids is derived once
(``merge_list``), written in the printable signs that stand for bytes, and handed to the library as one JSON string; its
size is bounded by the vocabulary. Tasks encode the distinct units of a slice (see ``tokens``) with ``encode_batch`` and
remember short ones. Offsets follow from the bytes of each token: a map from bytes to characters gives the characters a
token touches, so a token that holds part of a character covers all of it. Decoding reverses the byte table; a
character that several tokens share is put together from their bytes and belongs to the token that completes it.

Defined cases: null and empty texts have no ids and decode to nothing. Strings of special tokens are ordinary text. Null
ids and repeated rows are kept; extra columns are left out. Bytes that are no UTF-8 decode to the replacement sign; an
id that the table lacks fails the task. A text above a slice is encoded piece by piece.
"""

import base64
import codecs
import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsift.llm import textkit as T, tokens
from dealsift.llm.tables import documents

#: Ids a decoded Arrow batch is cut into, and unit strings given to the library at a time.
DECODE_IDS, BATCH_UNITS = 1 << 20, 20_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks: a line holds the string in base64 and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts from which merging by rank makes a token, None where no merge reaches it.

    When two parts become a token in some text, no earlier merge crossed its ends, so the merges inside it came in the order
    they have in the token alone (lowest rank, then leftmost). That order has one state of two parts: each token has one
    merge, and listing the merges by the rank of their result gives the library the same choices.
    """
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return None
        at = min(known)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """One merge for each token that merges reach, by rank; the others are only met as whole pre-tokens."""
    pairs = (last_pair(token, ranks) for token in sorted(ranks, key=ranks.get) if len(token) > 1)
    return [p for p in pairs if p is not None]


@functools.lru_cache(maxsize=4)
def tokenizer_json(path: str, pattern: str) -> str:
    """The library's file for a rank table: split by ``pattern``, bytes as signs, whole pre-tokens before merges."""
    ranks = read_ranks(path)
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"rank file without the bytes {missing[:5]}")
    signs = tokens.byte_signs()
    sign = {token: "".join(map(signs.get, token)) for token in ranks}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": byte_level,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}, byte_level]},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False,
                  "byte_fallback": False, "ignore_merges": True, "vocab": {sign[t]: r for t, r in ranks.items()}, "merges": [[sign[a], sign[b]] for a, b in merge_list(ranks)]}})


class RankEncoder:
    """Ids of units by the library, and bytes of ids by the reversed byte table, with the memory of one worker."""

    special: list[str] = []

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        byte_of = {s: b for b, s in tokens.byte_signs().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw[i] = bytes(map(byte_of.get, token))
        self.known_id = np.array([bool(r) for r in raw])
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.known = tokens.Memory()

    def encode(self, units: list[str]) -> list[bytes]:
        self.known.renew()
        out = [self.known.get(u) for u in units]
        new = [i for i, found in enumerate(out) if found is None]
        for at in range(0, len(new), BATCH_UNITS):
            some = new[at:at + BATCH_UNITS]
            for i, found in zip(some, self.tokenizer.encode_batch_fast([units[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(found.ids, dtype="<u4").tobytes()
                self.known.keep(units[i], out[i])
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and the bounds of each text."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.known_id) or not self.known_id[ids].all()):
            raise ValueError("ids beyond the rank table")
        at, ends = T.gather(self.offsets, ids.astype(np.int64))
        return self.bytes[at], ends[bounds]


_ENCODERS: dict[str, RankEncoder] = {}


def encoder(spec: str) -> RankEncoder:
    """One encoder per worker and table, kept between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = RankEncoder(spec)
    return _ENCODERS[key]


def spans(data: np.ndarray, text_bounds: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and end byte, first and end character of every token, counted in its own text.

    ``data`` and ``text_bounds`` are the bytes of the texts, ``sizes`` the bytes of each token, ``bounds`` the texts in
    the list of tokens. The end character is that behind the last one touched.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = np.repeat(text_bounds[:-1], np.diff(bounds))
    chars = leads[base]
    return starts - base, ends - base, leads[np.minimum(starts + 1, len(data))] - 1 - chars, leads[ends] - chars


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(kind)))


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id and its ids; with ``offsets`` also first and end byte and first and end character of each id."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))
    more = ("first_byte", "end_byte", "first_char", "end_char") if offsets else ()

    def run(batches):
        enc = encoder(spec.value)
        sizes = np.diff(enc.offsets)
        for batch in batches:
            for part in T.slices(batch):
                texts = part.column("text")
                ids, bounds = tokens.encode_slice(texts, enc)
                found = spans(*T.flat(texts), sizes[ids], bounds) if offsets else ()
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": _lists(ids, bounds, np.int32), **{n: _lists(v, bounds, np.int64) for n, v in zip(more, found)}})

    return documents(docs).mapInArrow(run, ", ".join(["doc_id long", "ids array<int>", *(f"{n} array<long>" for n in more)]))


def token_texts(parts: list[bytes]) -> list[str]:
    """Text of each token; a character split between tokens goes to the one that completes it."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    out = [reader.decode(p) for p in parts]
    rest = reader.decode(b"", True)
    return [*out[:-1], out[-1] + rest] if out else out


def decode(rows: DataFrame, path: str, pattern: str, pieces: bool = False) -> DataFrame:
    """doc_id, the text of its ids and the bytes they stand for; with ``pieces`` also the text of each id. Null ids: no id."""
    spec = rows.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))

    def run(batches):
        enc = encoder(spec.value)
        for batch in batches:
            at, sizes = 0, np.fromiter((len(x) if x.is_valid else 0 for x in batch.column("ids")), np.int64, len(batch))
            ends = np.cumsum(sizes)
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODE_IDS, side="right")))
                part = batch.slice(at, stop - at)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(sizes[at:stop])]).astype(np.int64)
                raw, cuts = enc.decode(ids, bounds)
                raw, cuts = raw.tobytes(), cuts.tolist()
                values = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                out = {"doc_id": part.column("doc_id"), "text": pa.array([v.decode("utf-8", "replace") for v in values], pa.string()), "raw": pa.array(values, pa.binary())}
                if pieces:
                    limits = np.concatenate([[0], np.cumsum(np.diff(enc.offsets)[ids])]).tolist()
                    strings = [raw[a:b] for a, b in zip(limits[:-1], limits[1:])]
                    edges = bounds.tolist()
                    out["pieces"] = pa.array([token_texts(strings[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(out)
                at = stop

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string, raw binary" + (", pieces array<string>" if pieces else ""))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, digests of the ids and of the decoded bytes."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))

    def run(batches):
        enc = encoder(spec.value)
        for batch in batches:
            for part in T.slices(batch):
                ids, bounds = tokens.encode_slice(part.column("text"), enc)
                raw, ends = enc.decode(ids, bounds)
                raw, codes = memoryview(raw).cast("B"), memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                limits, cuts = bounds.tolist(), ends.tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_sha256": [hashlib.sha256(codes[4 * a:4 * b]).hexdigest() for a, b in zip(limits[:-1], limits[1:])],
                    "decoded_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]})

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
