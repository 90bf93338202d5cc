"""Byte-pair encoding and decoding by a pair occurrence index.

The distinct words (pre-tokens) of a block of a partition lie in one array of symbols with links to their neighbours.
An index maps each mergeable pair, by its rank, to all its positions. Active ranks are taken in ascending order; all
positions of a rank are merged at once (in a run of equal symbols every second one, from the left), and the pairs that
arise at the merged places enter the lists of their ranks. As a merge only meets its own word, this gives each word the
result of merging its lowest-ranked pair again and again.

Only words a worker has not met before are encoded; see ``tokens`` for units and the memory of a worker. A block is at
most ``BLOCK_BYTES`` of text, so memory does not follow the partition.

Defined cases: null and empty texts have no ids and decode to the empty text. Strings of special tokens inside texts
become their id. Null ids and repeated rows are kept.
"""

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from dealsift.llm import textkit as T, tokens
from dealsift.llm.tables import documents

BLOCK_BYTES = 8 << 20
UNIT_BYTES = 16 << 20  # what a worker remembers; its executor also holds the workers of earlier stages


class Vocabulary:
    """Merge ranks and token bytes of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        signs = tokens.byte_signs()
        byte_of = {s: b for b, s in signs.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.base = np.array([vocab[signs[b]] for b in range(256)], dtype=np.int32)
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        self.size, self.left, self.right = size, left, right
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        codes = left * size + right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(byte_of[s] for s in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge is known."""
        code = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and the bounds of each text."""
        at, ends = T.gather(self.offsets, ids.astype(np.int64))
        return self.bytes[at], ends[bounds]


def merge_words(vocab: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words at once: their bytes in a row and the bounds of the words in, the same of ids out."""
    n = len(data)
    sym = vocab.base[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = np.flatnonzero(np.diff(bounds))
    after[bounds[filled + 1] - 1] = -1
    before[bounds[filled]] = -1
    at = np.flatnonzero(after >= 0)
    rank = vocab.ranks(sym[at], sym[after[at]])
    at, rank = at[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    cuts = np.flatnonzero(np.diff(rank, prepend=-1))
    index = {int(rank[a]): [at[a:b]] for a, b in zip(cuts, np.append(cuts[1:], len(rank)))}
    active = list(index)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        a, b = vocab.left[r], vocab.right[r]
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        right = after[pos]
        valid = (sym[pos] == a) & (right >= 0)
        valid &= sym[right] == b
        pos, right = pos[valid], right[valid]
        if a == b and len(pos) > 1:
            # runs of overlapping pairs: every second one from the left
            start = np.ones(len(pos), dtype=bool)
            start[1:] = right[:-1] != pos[1:]
            first = np.flatnonzero(start)
            even = (np.arange(len(pos)) - np.repeat(first, np.diff(first, append=len(pos)))) % 2 == 0
            pos, right = pos[even], right[even]
        if not len(pos):
            continue
        beyond = after[right]
        sym[pos] = vocab.merged[r]
        sym[right] = -1
        after[pos] = beyond
        more = beyond >= 0
        before[beyond[more]] = pos[more]
        ahead = before[pos]
        left = np.concatenate([ahead[ahead >= 0], pos[more]])
        if not len(left):
            continue
        found = vocab.ranks(sym[left], sym[after[left]])
        left, found = left[found >= 0], found[found >= 0]
        if len(found):
            order = np.argsort(found, kind="stable")
            left, found = left[order], found[order]
            cuts = np.flatnonzero(np.diff(found, prepend=-1))
            for x, y in zip(cuts, np.append(cuts[1:], len(found))):
                key = int(found[x])
                if key not in index:
                    index[key] = []
                    heapq.heappush(active, key)
                index[key].append(left[x:y] if y - x == 1 else np.unique(left[x:y]))
    alive = sym >= 0
    return sym[alive].astype("<u4"), np.concatenate([[0], np.cumsum(alive)])[bounds]


class Encoder:
    """Ids of units by the index above, with the memory of one worker."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.pattern = regex.compile(tokens.BYTE_PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocab.special, key=len, reverse=True))) + ")") if self.vocab.special else None
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.signs = {s: b for b, s in tokens.byte_signs().items()}
        self.units, self.words = tokens.Memory(UNIT_BYTES), tokens.Memory(UNIT_BYTES // 2)

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens; characters whose class is not certain go to the library's own splitter."""
        if not text.isascii() and tokens.unusual(text):
            return [bytes(self.signs[s] for s in piece).decode() for piece, _ in self.library.pre_tokenize_str(text)]
        return [text] if text.isalpha() else self.pattern.findall(text)

    def _split(self, unit: str) -> list[str]:
        if self.special is None or not any(s in unit for s in self.vocab.special):
            return self._pieces(unit)
        out = []
        for piece in self.special.split(unit):
            out += [piece] if piece in self.vocab.special else self._pieces(piece)
        return out

    def learn(self, units) -> dict[str, bytes]:
        """Ids of all given units; those not met before are encoded, all in one index."""
        self.units.renew()
        self.words.renew()
        found = {u: self.units[u] for u in units if u in self.units}
        split = {u: self._split(u) for u in units if u not in found}
        ids_of = {w: self.words[w] for words in split.values() for w in words if w in self.words}
        new = [w for w in dict.fromkeys(w for words in split.values() for w in words) if w not in ids_of]
        for w in new:
            if w in self.vocab.special:
                ids_of[w] = np.array([self.vocab.special[w]], dtype="<u4").tobytes()
        new = [w for w in new if w not in ids_of]
        data, bounds = T.flat(pa.array(new, pa.large_string()))
        ids, cut = merge_words(self.vocab, data, bounds)
        raw = ids.tobytes()
        for w, a, b in zip(new, cut[:-1].tolist(), cut[1:].tolist()):
            ids_of[w] = raw[4 * a:4 * b]
            self.words.keep(w, ids_of[w])
        for u, words in split.items():
            found[u] = b"".join([ids_of[w] for w in words])
            self.units.keep(u, found[u])
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches, path: str):
    """(slice, ids, bounds) for all slices of a partition; words are encoded block by block."""
    enc, block, held = encoder(path), [], 0

    def flush():
        found = enc.learn(dict.fromkeys(u for _, (_, units, _) in block for u in units))
        for part, (index, units, bounds) in block:
            yield part, *tokens.spread(index, [found[u] for u in units], bounds)

    for batch in batches:
        for part in T.slices(batch):
            block.append((part, tokens.distinct_units(part.column("text"), list(enc.vocab.special))))
            held += int(part.column("text").nbytes)
            if held >= BLOCK_BYTES:
                yield from flush()
                block, held = [], 0
    if block:
        yield from flush()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its ids."""
    def run(batches):
        for part, ids, bounds in encoded(batches, path):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))})

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids; bytes that are no UTF-8 become the replacement sign."""
    def run(batches):
        vocab = encoder(path).vocab
        for batch in batches:
            lists = batch.column("ids").cast(pa.large_list(pa.int32())).fill_null(pa.scalar([], pa.large_list(pa.int32()))) if batch.column("ids").null_count else batch.column("ids")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw, ends = vocab.decode(lists.flatten().to_numpy(zero_copy_only=False), bounds)
            raw = raw.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, digests of the ids and of the decoded text."""

    def run(batches):
        vocab = encoder(path).vocab
        for part, ids, bounds in encoded(batches, path):
            raw, ends = vocab.decode(ids, bounds)
            raw, codes = raw.tobytes(), memoryview(ids.astype("<u4")).cast("B")
            texts = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "ids_sha256": [hashlib.sha256(codes[4 * a:4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())],
                "decoded_sha256": [hashlib.sha256(t.decode("utf-8", "replace").encode()).hexdigest() for t in texts]})

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
