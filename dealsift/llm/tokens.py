"""Token ids of whole texts from distinct units.

A unit is a run of blanks followed by a run of other characters, and letters are parted from ASCII signs. In every
tokenizer used here a token never spans the place where a blank follows another character or a letter meets a sign (an
apostrophe before a letter apart), so a text may be cut there and the ids of its units joined give the ids of the text.
A blank outside ASCII joins the run of blanks around it, and a string of a special token is not cut; both bind only their
own neighbourhood. Texts repeat their units a lot: each distinct unit of a slice is encoded once, and a worker remembers
short units it has met (``Memory``, bounded in bytes), so encoding follows the vocabulary of the corpus and the rest is
array work.
"""

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from dealsift.llm import textkit as T

#: What a worker remembers: units of at most so many characters, up to so many bytes in all.
SHORT, KNOWN_BYTES = 64, 128 << 20
#: About what one entry costs beside its characters and ids: two objects and their place in the dictionary.
ENTRY_BYTES = 190

#: Blanks and separators outside the six ASCII blanks.
_OTHER_BLANKS = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_OTHER_BLANK_BYTES = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


class Memory(dict):
    """Ids of short units, up to ``limit`` bytes; ``renew`` empties it when it is full. Long units are never kept."""

    def __init__(self, limit: int = KNOWN_BYTES):
        super().__init__()
        self.limit, self.held = limit, 0

    def keep(self, unit: str, ids: bytes) -> None:
        if len(unit) <= SHORT:
            self[unit] = ids
            self.held += len(unit) * (1 if unit.isascii() else 4) + len(ids) + ENTRY_BYTES

    def renew(self) -> None:
        if self.held > self.limit:
            self.clear()
            self.held = 0


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[b for b in range(33, 127) if not _LETTER[b]]] = True


def _between_letter_and_sign(data: np.ndarray) -> np.ndarray:
    """Where a letter meets an ASCII sign or digit: a token ends there, but behind an apostrophe.

    Letters are those of ASCII and Latin-1; behind any other character the place is left alone.
    """
    second = np.zeros(len(data), dtype=bool)  # second byte of a Latin-1 letter
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    starts = _LETTER[data]
    ends = starts | second
    starts[:-1] |= second[1:]
    sign = _SIGN[data]
    out = np.zeros(len(data), dtype=bool)
    out[1:] = (ends[:-1] & sign[1:]) | (sign[:-1] & (data[:-1] != 39) & starts[1:])
    return out


def unit_starts(texts: pa.Array, data: np.ndarray, bounds: np.ndarray, special: list[str]) -> np.ndarray:
    """Byte position of every unit."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = T.BLANK[data]
    first = _between_letter_and_sign(data)
    first[1:] |= blank[1:] & ~blank[:-1]
    odd = pc.match_substring_regex(texts, _OTHER_BLANKS)
    for string in special:
        odd = pc.or_(odd, pc.match_substring(texts, string))
    whole = re.compile(b"|".join(re.escape(string.encode()) for string in special)) if special else None
    for i in np.flatnonzero(pc.fill_null(odd, False).to_numpy(zero_copy_only=False)):
        at, text = bounds[i], data[bounds[i]:bounds[i + 1]].tobytes()
        behind = np.fromiter((m.end() for m in _OTHER_BLANK_BYTES.finditer(text)), np.int64)
        first[at + behind[behind < len(text)]] = False
        for m in whole.finditer(text) if whole else ():
            first[at + m.start() + 1:at + m.end()] = False
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(first)


def distinct_units(texts: pa.Array, special: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Which distinct unit each unit is, the distinct units, and the bounds of the texts in the list of units."""
    data, bounds = T.flat(texts)
    starts = unit_starts(texts, data, bounds, special)
    offsets = np.append(starts, len(data)).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    coded = units.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(starts, bounds)


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


#: Fixed value: the pattern of the byte-level pre-tokenizer, with its blanks written out.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def unusual(text: str) -> bool:
    """Whether a character is outside the basic plane or unassigned here: tables of different libraries may differ on it."""
    return any(c > "\uffff" or (c > "\xff" and unicodedata.category(c) == "Cn") for c in text)


class Library:
    """Ids of units by the tokenizers library, with the memory of one worker.

    Most of the library's time on a short text goes into its pipeline before the model. For the two pipelines known here
    (byte-level, and lower-cased words) units are split and written in byte signs first, and only new words go to the
    library's model; any other file, and units with special strings, take the whole pipeline.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        self.lower = False
        self.pattern = None
        if spec["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
            self.pattern = regex.compile(BYTE_PATTERN)
        elif (spec["model"]["type"] == "BPE" and before.get("type") == "Sequence" and [p["type"] for p in before["pretokenizers"]] == ["Split", "ByteLevel"]
              and before["pretokenizers"][0]["invert"] and not before["pretokenizers"][1]["use_regex"]
              and normal and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]):
            self.pattern = regex.compile(before["pretokenizers"][0]["pattern"]["Regex"])
            self.lower = True
        self.signs = str.maketrans({b: s for b, s in byte_signs().items() if chr(b) != s})
        self.known, self.words = Memory(), Memory(KNOWN_BYTES // 2)

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token by the model; latin-1 gives each byte one character, which becomes its sign."""
        signs = word.translate(self.signs) if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        plain = unit.isascii()
        if self.pattern is None or (not plain and unusual(unit)) or (len(unit) > 12 and any(s in unit for s in self.special)):
            return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        if self.lower:
            unit = unit.lstrip(" \t\n\r\x0b\x0c")
            if not plain:
                unit = unicodedata.normalize("NFC", unit)
            # letter by letter, as the library does: no final sigma
            unit = unit.lower() if plain or "\u03a3" not in unit else "".join(map(str.lower, unit))
            if not unit.isalpha():
                return b"".join(map(self._word, self.pattern.findall(unit)))
            found = self.words.get(unit)
            if found is None:
                found = self._word(unit)
                self.words.keep(unit, found)
            return found
        if unit.isalpha() or (unit[0] == " " and unit[1:].isalpha()):
            return self._word(unit)
        return b"".join(map(self._word, self.pattern.findall(unit)))

    def encode(self, units: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        self.known.renew()
        self.words.renew()
        known = self.known
        out = [known.get(u) for u in units]
        for i, found in enumerate(out):
            if found is None:
                out[i] = self._unit(units[i])
                known.keep(units[i], out[i])
        return out


_LIBRARIES: dict[str, Library] = {}


def library(path: str) -> Library:
    """One library object per worker and file, kept between tasks."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = Library(path)
    return _LIBRARIES[path]


def encode(texts: pa.Array, encoder) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and the bounds of each text in them."""
    index, units, bounds = distinct_units(texts, encoder.special)
    return spread(index, encoder.encode(units), bounds)


def spread(index: np.ndarray, found: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units from the ids of the distinct ones."""
    offsets = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=offsets[1:])
    ids = np.frombuffer(b"".join(found), dtype="<u4")
    at, ends = T.gather(offsets, index)
    return ids[at], ends[bounds]


def lengths(texts: pa.Array, encoder) -> np.ndarray:
    """Number of ids of each text; no id is kept."""
    index, units, bounds = distinct_units(texts, encoder.special)
    found = encoder.encode(units)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.diff(np.concatenate([[0], np.cumsum(sizes[index])])[bounds])


def cut_long(text: bytes, limit: int = T.SLICE_BYTES, special: list[str] | None = None) -> list[bytes]:
    """A long text in pieces of about ``limit`` bytes, each ending where a unit does; one without such a place stays whole."""
    if len(text) <= limit:
        return [text]
    array_, data = pa.array([text.decode()], pa.large_string()), np.frombuffer(text, np.uint8)
    places = unit_starts(array_, data, np.array([0, len(text)]), special or [])
    out, at = [], 0
    while len(text) - at > limit:
        k = np.searchsorted(places, at + limit, side="right") - 1
        if k < 0 or places[k] <= at:
            k = np.searchsorted(places, at, side="right")
            if k == len(places):
                break
        out.append(text[at:places[k]])
        at = int(places[k])
    return out + [text[at:]]


def encode_slice(texts: pa.Array, encoder, limit: int = T.SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """``encode`` of a slice; a single text above ``limit`` bytes goes piece by piece."""
    if len(texts) != 1 or not texts[0].is_valid or pc.binary_length(texts)[0].as_py() <= limit:
        return encode(texts, encoder)
    pieces = cut_long(texts[0].as_py().encode(), limit, encoder.special)
    ids = np.concatenate([encode(pa.array([p.decode()], pa.large_string()), encoder)[0] for p in pieces])
    return ids, np.array([0, len(ids)])
