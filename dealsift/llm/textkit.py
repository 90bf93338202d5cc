"""Array helpers for whole texts inside Arrow tasks: bytes, words, hashes of words and word windows.

Texts are handled in slices of a few megabytes (``slices``), so the memory of a task does not follow the number of rows
in an Arrow batch; one longer text is a slice of its own. Words are ``[^\\x20\\x09-\\x0D]+``: only ASCII blanks separate,
so words can be found in the UTF-8 bytes. Null texts count as empty.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Random value of a byte, once for each hash lane; blanks are 0, so they add nothing to a word.
_BYTES = {lane: np.where(BLANK, np.uint64(0), _odd(100 + lane, 256)) for lane in (0, 1)}
_STEP = {lane: int(_odd(200 + lane, 1)[0]) for lane in (0, 1)}
_WINDOW = {lane: _odd(300 + lane, 64) for lane in (0, 1)}


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 bounds of the texts in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def give_back() -> None:
    """Return freed memory to the system: workers stay between tasks, and what they keep counts for their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Consecutive parts of a batch with at most ``limit`` text bytes each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if len(batch) else []
    ends = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    give_back()


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 bounds of the texts in the list of words."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(bounds), np.int64)
    inside = ~BLANK[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = ~inside[:-1] | ~inside[1:]
    edge[bounds] = True
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of every word: random byte values times powers of an odd number, summed per word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = data[starts[0]:]
    starts = starts - starts[0]
    lengths = np.diff(starts, append=len(data))
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max()), _STEP[lane], dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        # the blanks behind a word are 0, so the sum may run up to the next word
        values = _BYTES[lane][data] * powers[np.arange(len(data)) - np.repeat(starts, lengths)]
        return mix(np.add.reduceat(values, starts))


def window_hashes(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of the words [i, i + size) for every i for which they exist; text bounds are the caller's business."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * _WINDOW[lane][0]
        for k in range(1, size):
            out += hashes[k:k + n] * _WINDOW[lane][k]
        return mix(out)


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Index of the first word of every window that lies within one text."""
    n = int(bounds[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, dtype=bool)
    for k in range(1, size):
        # a window may not cross the bound b: starts b - size + 1 .. b - 1 are out
        at = bounds[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    # empty texts repeat a bound; a bound at 0 or at the end excludes nothing
    return np.flatnonzero(ok)


def owner(bounds: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The text that each word (or byte) index belongs to."""
    return np.searchsorted(bounds, index, side="right") - 1


def gather(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the lists ``picks`` of a ragged array with ``offsets``, and the bounds of each list."""
    sizes = (offsets[1:] - offsets[:-1])[picks]
    bounds = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return np.arange(bounds[-1]) + np.repeat(offsets[picks] - bounds[:-1], sizes), bounds
