"""Exact substring dedup with fixed-block anchors.

A word goes if it lies in a window of ``WINDOW`` consecutive words that also starts in a document with a smaller id;
windows are judged on the input. The search has two rounds, over documents dealt to chunks of bounded size:

1. Anchors. Reference blocks are the non-overlapping 7-word blocks of every document, probes are all rolling 7-word
   windows. A window of 13 words holds a whole block wherever it starts, so a repeated window has a probe that meets an
   indexed block, in both places. Each chunk sends the sorted distinct fingerprints of its probes, with a mark for those
   that are blocks, to buckets of the fingerprint space; a bucket answers with one bit per fingerprint: met in another
   document and a block somewhere. Fingerprints have 32 bits within a bucket. The number of buckets follows the data, so
   chance hits stay rare; they only cost work in the second round.
2. Extension. Around the hits every 13-word window is a candidate. Chunks send 96-bit hashes of their distinct
   candidates with the smallest document that has them; a bucket answers with one bit: a smaller document elsewhere has
   it too. Runs of such windows make up the maximal repeats, and their words go.

A fingerprint that is everywhere is one entry per chunk, however many documents share it, so hot passages and groups of
copies need no special way. Each group of rows is one chunk or one bucket: bounded by ``chunk_bytes`` and
``bucket_bytes`` (one longer document is a chunk's only large row). The documents are shuffled once; all three passes
use the same exchange.

Defined cases: null, empty and blank texts have no words. A null id counts as the largest. Rows with equal ids do not
remove from each other. All rows are returned, repeated ones too.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsift.llm import textkit as T
from dealsift.llm.tables import NULL_ID, importable, parts, text_bytes

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20

_MESSAGE = "target long, sender long, kind int, body binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal significance together: what is small compresses well in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(body: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Chunk:
    """Words and windows of the documents of one chunk, in ascending order of their ids."""

    def __init__(self, rows: pa.Table, window: int):
        ids = rows.column("doc_id").fill_null(NULL_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.rows = rows.take(pa.array(self.order)).combine_chunks()
        self.window, self.block = window, (window + 1) // 2
        hashes, counts = ([], []), []
        for part in T.slices(self.rows):
            data, bounds = T.flat(part.column("text").combine_chunks() if isinstance(part.column("text"), pa.ChunkedArray) else part.column("text"))
            starts, _, wb = T.words(data, bounds)
            counts.append(np.diff(wb))
            for lane in (0, 1):
                hashes[lane].append(T.word_hashes(data, starts, lane))
        self.hashes = [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes]
        self.bounds = np.concatenate([[0], *[np.cumsum(np.concatenate(counts))]]).astype(np.int64) if counts else np.zeros(1, np.int64)

    def probes(self, buckets: int):
        """Distinct fingerprints, which are blocks, which are in several documents, and the place of every probe's one."""
        at = T.window_starts(self.bounds, self.block)
        doc = T.owner(self.bounds, at)
        h = T.window_hashes(self.hashes[0], self.block)[at]
        key = (_bucket(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        key, doc, anchor = key[order], doc[order], ((at - self.bounds[doc]) % self.block == 0)[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        last = np.append(first, len(key))[1:] - 1
        place = np.zeros(len(key), np.int64)
        place[order] = np.repeat(np.arange(len(first)), last - first + 1)
        return key[first], np.logical_or.reduceat(anchor, first) if len(first) else anchor, doc[first] != doc[last], at, place

    def candidates(self, hit: np.ndarray, at: np.ndarray):
        """Start of every candidate window, and its two hashes: windows with a hit probe inside."""
        found = np.zeros(len(self.hashes[0]) + 1, np.int64)
        found[at[hit] + 1] = 1
        found = np.cumsum(found)
        starts = T.window_starts(self.bounds, self.window)
        starts = starts[found[starts + self.window - self.block + 1] > found[starts]]
        lanes = []
        with np.errstate(over="ignore"):
            for lane in (0, 1):
                h = self.hashes[lane][starts] * T._WINDOW[lane][0]
                for k in range(1, self.window):
                    h += self.hashes[lane][starts + k] * T._WINDOW[lane][k]
                lanes.append(T.mix(h))
        return starts, lanes[0], (lanes[1] >> np.uint64(32)).astype(np.uint32)

    def entries(self, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray):
        """Distinct candidates in order, the first document of each, and the place of every window's one."""
        order = np.lexsort((starts, h2, h1))
        a, b, doc = h1[order], h2[order], T.owner(self.bounds, starts[order])
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        place = np.zeros(len(a), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(a)))
        return a[first], b[first], self.ids[doc[first]], place


def _cuts(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _messages(rows) -> pa.Table:
    target, sender, kind, body = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"target": pa.array(target, pa.int64()), "sender": pa.array(sender, pa.int64()), "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary())})


def _spread(found: pa.Table, sizes: np.ndarray, kind: int) -> np.ndarray:
    """One bit for each entry of a chunk, from the answers of the buckets."""
    out = np.zeros(int(sizes[-1]), dtype=bool)
    for k, sender, body in zip(found.column("kind").to_pylist(), found.column("sender").to_pylist(), found.column("body")):
        if k == kind:
            a, b = sizes[sender], sizes[sender + 1]
            out[a:b] = np.unpackbits(np.frombuffer(body.as_py(), np.uint8), count=b - a)
    return out


def _answer(bits: np.ndarray, sizes: list[int], senders: list[int], me: int, kind: int):
    ends = np.cumsum([0, *sizes])
    return [(s, me, kind, np.packbits(bits[a:b]).tobytes()) for s, a, b in zip(senders, ends[:-1], ends[1:])]


def _meet_probes(key, rows):
    """A bucket of round 1: which fingerprints are in several documents and a block in one of them."""
    values, anchors, several, sizes = [], [], [], []
    for body in rows.column("body"):
        raw = body.as_py()
        n = int.from_bytes(raw[:8], "little")
        values.append(np.cumsum(_unplanes(raw[8:8 + 4 * n], "<u4"), dtype=np.uint32))
        marks = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 + 4 * n), count=2 * n).astype(bool)
        anchors.append(marks[:n])
        several.append(marks[n:])
        sizes.append(n)
    value, anchor, many = map(np.concatenate, (values, anchors, several))
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    count = np.diff(first, append=len(value))
    hit = np.logical_or.reduceat(anchor[order], first) & ((count > 1) | np.logical_or.reduceat(many[order], first))
    bits = np.zeros(len(value), bool)
    bits[order] = np.repeat(hit, count)
    return _messages(_answer(bits, sizes, rows.column("sender").to_pylist(), key[0].as_py(), 1))


def _meet_candidates(key, rows):
    """A bucket of round 2: which candidates a smaller document elsewhere has."""
    h1, h2, ids, sizes = [], [], [], []
    for body in rows.column("body"):
        raw = body.as_py()
        n = len(raw) // 20
        h1.append(np.frombuffer(raw, "<u8", n))
        h2.append(np.frombuffer(raw, "<u4", n, 8 * n))
        ids.append(_unplanes(raw[12 * n:], "<i8"))
        sizes.append(n)
    a, b, doc = map(np.concatenate, (h1, h2, ids))
    order = np.lexsort((b, a))
    a, b, sorted_doc = a[order], b[order], doc[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = np.minimum.reduceat(sorted_doc, first)
    bits = np.zeros(len(a), bool)
    bits[order] = np.repeat(least, np.diff(first, append=len(a))) < sorted_doc
    return _messages(_answer(bits, sizes, rows.column("sender").to_pylist(), key[0].as_py(), 2))


def remove_repeats(docs: DataFrame, window: int = WINDOW, rewrite: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text of the kept words) for every row.

    With ``rewrite`` instead all columns of ``docs``, the text of rows that lose words replaced by their kept words.
    """
    importable(docs.sparkSession)
    size = text_bytes(docs)
    chunks, buckets = parts(size, chunk_bytes), parts(size, bucket_bytes)
    table = (docs if rewrite else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    dealt = table.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def send_probes(key, rows):
        values, anchor, several, _, _ = Chunk(rows, window).probes(buckets)
        cut, out = _cuts(values >> np.uint64(32), buckets), []
        for k in range(buckets):
            a, b = cut[k], cut[k + 1]
            if a < b:
                low = (values[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                marks = np.packbits(np.concatenate([anchor[a:b], several[a:b]])).tobytes()
                out.append((k, key[0].as_py(), 0, int(b - a).to_bytes(8, "little") + _planes(np.diff(low, prepend=np.uint32(0))) + marks))
        return _messages(out)

    def extended(rows: pa.Table, found: pa.Table):
        chunk = Chunk(rows, window)
        values, _, _, at, place = chunk.probes(buckets)
        hit = _spread(found, _cuts(values >> np.uint64(32), buckets), 1)
        starts, h1, h2 = chunk.candidates(hit[place], at)
        a, b, ids, place = chunk.entries(starts, h1, h2)
        return chunk, starts, a, b, ids, place

    def send_candidates(key, rows, found):
        _, _, a, b, ids, _ = extended(rows, found)
        cut, me = _cuts(_bucket(a, buckets), buckets), key[0].as_py()
        # the answers of round 1 travel along to the last pass
        out = [(buckets + me, s, k, body.as_py()) for s, k, body in zip(found.column("sender").to_pylist(), found.column("kind").to_pylist(), found.column("body"))]
        for k in range(buckets):
            x, y = cut[k], cut[k + 1]
            if x < y:
                out.append((k, me, 0, a[x:y].astype("<u8").tobytes() + b[x:y].astype("<u4").tobytes() + _planes(ids[x:y].astype("<i8"))))
        return _messages(out)

    def meet(key, rows):
        if key[0].as_py() < buckets:
            return _meet_candidates(key, rows)
        return rows.set_column(0, "target", pa.array([key[0].as_py() - buckets] * len(rows), pa.int64()))

    def finish(key, rows, found):
        chunk, starts, a, _, ids, place = extended(rows, found)
        beaten = _spread(found, _cuts(_bucket(a, buckets), buckets), 2)
        doc = chunk.ids[T.owner(chunk.bounds, starts)]
        gone = starts[beaten[place] | (doc > ids[place])]
        cover = np.zeros(len(chunk.hashes[0]) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.subtract.at(cover, gone + window, 1)
        removed = np.cumsum(cover)[:-1] > 0
        bounds, out = chunk.bounds.tolist(), {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        before = np.concatenate([[0], np.cumsum(removed)]).tolist()
        for i, text in enumerate(chunk.rows.column("text")):
            words = (text.as_py() or "").encode().split()
            lost = before[bounds[i + 1]] - before[bounds[i]]
            if rewrite and not lost:
                out["kept"].append(text.as_py())
                continue
            kept = b" ".join(compress(words, ~removed[bounds[i]:bounds[i + 1]])) if lost else b" ".join(words)
            if not rewrite:
                out["n_words"].append(len(words))
                out["n_removed"].append(lost)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode())
        if rewrite:
            rows = chunk.rows.drop_columns(["__chunk"])
            return rows.set_column(rows.column_names.index("text"), "text", pa.array(out["kept"], pa.string()))
        return pa.table({"doc_id": chunk.rows.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in out.items() if k.startswith("n_")},
                         "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.string())})

    by_chunk = dealt.groupBy("__chunk")
    probed = by_chunk.applyInArrow(send_probes, _MESSAGE)
    answers = probed.groupBy("target").applyInArrow(_meet_probes, _MESSAGE)
    wanted = by_chunk.cogroup(answers.groupBy("target")).applyInArrow(send_candidates, _MESSAGE)
    verdicts = wanted.groupBy("target").applyInArrow(meet, _MESSAGE)
    schema = table.schema if rewrite else "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return by_chunk.cogroup(verdicts.groupBy("target")).applyInArrow(finish, schema)


ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
     win AS (SELECT r, doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t)),
     bad AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
     gone AS (SELECT r, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM bad GROUP BY r),
     kept AS (SELECT doc_id, ws, coalesce(g, []) AS g FROM t LEFT JOIN gone USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(g)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN len(g) = 0 THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM kept"""
