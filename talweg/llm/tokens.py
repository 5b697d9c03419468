"""Public tokenizers over blocks of texts: what the alignment and the token store share.

Invented and natural prose alike repeat their words, so a block is cut into units, each distinct unit is
encoded once and the ids are dealt back to all its places.  A cut lies before a space that stands
between two characters that are surely none (printable ASCII, Latin or Cyrillic letters).  Both kinds of
tokenizer always end a token there: the byte tokenizer because no pre-token of its pattern holds a space
after anything else, the piece tokenizer because none of its pieces holds the space mark after anything
else (both are looked up in the tokenizer, and texts stay whole where it does not hold).  ``fine`` cuts,
for the byte tokenizer alone, lie before such a line break too and between a letter and a point.  So ids
are those of the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from tokenizers import Tokenizer

BLOCK_BYTES = 8_000_000
JOINED, AT_ONCE = 1_000, 20
REMEMBER, REMEMBER_BYTES = 1 << 18, 64
MARK = "▁"


def _set(values: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


_PRINTABLE = _set(range(0x21, 0x7F))
# First of two bytes of a Latin or Cyrillic letter (U+00C0-U+017F, U+0400-U+047F): no white space among them.
_LEAD = _set([0xC3, 0xC4, 0xC5, 0xD0, 0xD1])
_LETTER = _set([*range(65, 91), *range(97, 123)])
_POINT = _set(b".,;:!?")
_GAP = _set(b" \n")


def _cut(raw: bytes, fine: bool = False) -> np.ndarray:
    """For each byte of ``raw`` whether a new unit begins there (never at the first)."""
    b, out = np.frombuffer(raw, dtype=np.uint8), np.zeros(len(raw), dtype=bool)
    if len(b) < 3:
        return out
    lead = _LEAD[b]
    ends = _PRINTABLE[b]  # bytes that end a character that is no white space
    ends[1:] |= lead[:-1]
    begins = _PRINTABLE[b] | lead
    gap = (b == 32) | (b == 10) if fine else b == 32
    out[1:-1] = gap[1:-1] & ends[:-2] & begins[2:]
    if fine:
        out[1:] |= _POINT[b[1:]] & _LETTER[b[:-1]]
    return out


def cuts_of(raw: bytes, fine: bool = False) -> np.ndarray:
    """Offsets inside ``raw`` where a new unit begins."""
    return np.flatnonzero(_cut(raw, fine))


def fragments(text: bytes, whole: bool = False, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """``text`` in parts of about ``limit`` bytes that end at cuts; one part if it has none."""
    begin = 0
    while not whole and len(text) - begin > limit:
        at = cuts_of(text[begin : begin + limit])
        if not len(at):  # a stretch without a cut is taken up to the next one
            later = cuts_of(text[begin:])
            if not len(later):
                break
            at = later[:1]
        yield text[begin : begin + int(at[-1])]
        begin += int(at[-1])
    yield text[begin:]


class Units:
    """Distinct units of a block: those of ``dictionary`` at ``codes[first[i]:first[i + 1]]`` joined are text ``i``."""

    def __init__(self, raw: bytes, ends: np.ndarray, whole: bool = False, fine: bool = False):
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        cut = np.zeros(len(raw), dtype=bool) if whole else _cut(raw, fine)
        cut[starts[starts < len(raw)]] = True
        begins = np.flatnonzero(cut)
        at = np.append(begins, len(raw)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        self.dictionary, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.first = np.searchsorted(begins, np.append(starts, len(raw)))


def bytes_of(units: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """All bytes of an array without nulls, and where each value begins (with an end)."""
    _, at, data = units.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[units.offset : units.offset + len(units) + 1] if len(units) else np.zeros(1, dtype=np.int64)
    return memoryview(data or b"").cast("B")[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


def ragged(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[offsets[c]:offsets[c + 1]]`` of each code after another, and where each begins (with an end)."""
    sizes = np.diff(offsets)[codes]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(begin[-1]) + np.repeat(offsets[codes] - begin[:-1], sizes)
    return values[at], begin


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(offsets[-1])), offsets


def _encoded(units: pa.LargeBinaryArray, lengths: np.ndarray, lead: int, together: Callable[[list[str]], list], alone: Callable[[list[str]], list]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every unit, encoded many in a row where both neighbours are sure to be cut apart.

    ``lengths`` are the bytes of each id; they tell the units' ids apart again.  ``lead`` bytes before a
    text are left to the model to put.
    """
    data, at = bytes_of(units)
    raw, size, last = np.frombuffer(data, dtype=np.uint8), np.diff(at), at[1:] - 1
    if not len(units):
        return np.empty(0, dtype=np.uint32), at
    second = raw[np.minimum(at[:-1] + 1, len(raw) - 1)]
    ended = _PRINTABLE[raw[last]] | _LEAD[raw[np.maximum(last - 1, 0)]] & (size > 2)
    joins = (size > 1) & _GAP[raw[at[:-1]]] & (_PRINTABLE[second] | _LEAD[second]) & ended
    row, apart = np.flatnonzero(joins), np.flatnonzero(~joins)
    some, some_at = bytes_of(units.take(pa.array(row)).cast(pa.large_binary())) if len(apart) else (data, at)
    held, counts, odd = [], np.zeros(len(units), dtype=np.int64), []
    for begin in range(0, len(row), JOINED * AT_ONCE):
        groups = [(g, min(g + JOINED, len(row))) for g in range(begin, min(begin + JOINED * AT_ONCE, len(row)), JOINED)]
        lists = together([str(some[some_at[g] + lead : some_at[e]], "utf-8", "replace") for g, e in groups])
        for (g, e), ids in zip(groups, lists, strict=True):
            own = np.array(ids, dtype=np.uint32)
            ends = np.cumsum(lengths[own])
            if not len(own) or ends[-1] != some_at[e] - some_at[g]:  # the model writes some of it otherwise
                odd.append(row[g:e])
                continue
            held.append((row[g:e], own))
            counts[row[g:e]] = np.diff(np.searchsorted(ends, some_at[g + 1 : e + 1] - some_at[g], side="right"), prepend=0)
    rest = np.concatenate((*odd, apart)).astype(np.int64)
    lists = []
    for begin in range(0, len(rest), 2000):
        lists += alone([str(data[at[k] + lead : at[k + 1]], "utf-8", "replace") for k in rest[begin : begin + 2000]])
    own, upto = _flat(lists)
    counts[rest] = np.diff(upto)
    # back into the order of the units
    order = np.concatenate((*[k for k, _ in held], rest)).astype(np.int64)
    ids = np.concatenate((*[x for _, x in held], own))
    if np.array_equal(order, np.arange(len(units))):
        return ids, np.concatenate(([0], np.cumsum(counts)))
    starts = np.zeros(len(units), dtype=np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    return _gathered(ids, starts, counts)


def _gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return ids[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], counts)], offsets


def _byte_characters() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Byte-level BPE of the tokenizers library.

    ``literal`` takes the strings of special tokens inside texts as plain text.
    """

    def __init__(self, path: str, literal: bool = False):
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = literal
        spec = json.loads(self.model.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.byte_level = before.get("type") == "ByteLevel" and not spec.get("normalizer")
        self.whole = not (self.byte_level and before.get("use_regex") and not before.get("add_prefix_space"))
        self.size = max(self.model.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        if self.byte_level:
            table = _byte_characters()
            for token, i in self.model.get_vocab(with_added_tokens=False).items():
                self.bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
            for i, token in self.model.get_added_tokens_decoder().items():
                self.bytes[i] = token.content.encode()
                self.whole |= any(c in token.content for c in " \n.,;:!?")
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.names = pa.array(map(str, range(self.size)))

    def encode(self, units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units after another, and where each unit's begin (with an end)."""
        if self.whole:
            data, at = bytes_of(units)
            return _flat(self._lists([str(data[s:e], "utf-8", "replace") for s, e in zip(at[:-1], at[1:], strict=True)]))
        return _encoded(units, self.lengths, 0, self._lists, self._lists)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """SentencePiece with byte fallback; it puts a space before what it encodes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.whole = any(MARK in p.lstrip(MARK) for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.names = pa.array(map(str, range(self.size)))

    def encode(self, units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """As ``ByteTokens.encode``, for units that begin with a space, which is left to the model to put."""
        if self.whole:
            data, at = bytes_of(units)
            return _flat(self._lists([str(data[s + 1 : e], "utf-8", "replace") for s, e in zip(at[:-1], at[1:], strict=True)]))
        return _encoded(units, self.lengths, 1, lambda texts: [[] if MARK in t else x for t, x in zip(texts, self._lists(texts), strict=True)], self._lists)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Remembered:
    """Ids of units by ``model``, which encodes a unit only where it is not remembered from earlier blocks.

    Units of at most ``REMEMBER_BYTES`` are kept in two generations of at most ``most`` each: a full younger
    one becomes the older one at the next block, and what was not asked for meanwhile is forgotten.
    """

    def __init__(self, model: ByteTokens, most: int = REMEMBER):
        self.model, self.most = model, most
        self.younger: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, units: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """As ``ByteTokens.encode``."""
        if self.model.whole:  # whole texts seldom repeat
            return self.model.encode(units)
        words = units.to_numpy(zero_copy_only=False).tolist()
        held = list(map(self.younger.get, words))
        left = [i for i, ids in enumerate(held) if ids is None]
        asked = [words[i] for i in left]
        found = list(map(self.older.get, asked))
        new = [k for k, ids in enumerate(found) if ids is None]
        ids, at = self.model.encode(units.take(pa.array([left[k] for k in new], pa.int64())))
        raw, at = ids.astype(np.uint32).tobytes(), (at * 4).tolist()
        for k, begin, end in zip(new, at[:-1], at[1:], strict=True):
            found[k] = raw[begin:end]
        for i, ids in zip(left, found, strict=True):
            held[i] = ids
        if len(self.younger) >= self.most:
            self.older, self.younger = self.younger, {}
        short = ((w, ids) for w, ids in zip(asked, found, strict=True) if len(w) <= REMEMBER_BYTES)
        self.younger.update(islice(short, self.most - len(self.younger)))
        return np.frombuffer(b"".join(held), dtype=np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in held], dtype=np.int64) // 4))


@lru_cache(maxsize=4)
def byte_tokens(path: str, literal: bool = False) -> ByteTokens:
    """The tokenizer of this process: a worker runs many tasks and loads it once."""
    return ByteTokens(path, literal)


@lru_cache(maxsize=1)
def remembered(path: str) -> Remembered:
    """The same with the units of this process's earlier tasks."""
    return Remembered(byte_tokens(path))


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES, whole: bool = False, prefix: bytes = b"") -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """(numbers of the texts, their bytes after another, their ends) in blocks of about ``limit`` bytes.

    Nulls are empty; a text longer than a block stands in several.
    """
    data, at = bytes_of(pc.fill_null(column, "").cast(pa.large_binary()))
    numbers: list[int] = []
    parts: list[bytes | memoryview] = []
    size = 0

    def block() -> tuple[list[int], bytes, np.ndarray]:
        lengths = [len(p) for p in parts]
        if prefix:  # each prefix is a part of its own
            lengths = [a + b for a, b in zip(lengths[::2], lengths[1::2], strict=True)]
        return numbers, b"".join(parts), np.cumsum(lengths)

    for i in range(len(column)):
        text = data[at[i] : at[i + 1]]
        pieces = [text] if len(text) <= limit else fragments(bytes(text), whole, limit)
        for k, part in enumerate(pieces):
            if parts and size + len(part) > limit:
                yield block()
                numbers, parts, size = [], [], 0
            numbers.append(i)
            if prefix:
                parts.append(b"" if k else prefix)
            parts.append(part)
            size += len(part)
    if parts:
        yield block()
