"""Words of whole texts as numpy arrays over Arrow's own bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW_BASE = 0xD6E8FEB86659FD93
SECOND_BASE = 0xA0761D6478BD642F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEPT_POWERS = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Words:
    """`buf` holds the texts; word i is buf[start[i]:end[i]]; document d has the words ptr[d] to ptr[d + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    offset: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def pieces_of(column: pa.Array, size: int) -> Iterator[slice]:
    """Slices of about `size` bytes of text, whole rows."""
    lengths = pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def text_bytes(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offset at which each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(texts) else buf[:0], offsets - (offsets[0] if len(texts) else 0)


def words_of(texts: pa.ChunkedArray | pa.Array, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; `lower` turns A-Z into a-z first."""
    buf, offset = text_bytes(texts)
    if lower:
        buf = _LOWER[buf]
    word = ~_SPACE[buf]
    fresh = np.zeros(len(buf) + 1, bool)
    fresh[offset] = True  # a text begins or ends here
    after = np.zeros(len(buf), bool)
    after[1:] = word[:-1]
    start = np.flatnonzero(word & (~after | fresh[:-1]))
    before = np.zeros(len(buf), bool)
    before[:-1] = word[1:]
    end = np.flatnonzero(word & (~before | fresh[1:])) + 1
    return Words(buf, start, end, np.searchsorted(start, offset), offset)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i up to n. Only short tables are kept: a worker lives on after its
    task, and a chunk's tables would stay with it."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n, KEPT_POWERS)
        have = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
            for b in (base, pow(base, -1, 1 << 64))
        )
        if size == KEPT_POWERS:
            _powers[base] = have
    return have


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end], for all spans at once, by prefix sums."""
    up, down = powers(base, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def word_hashes(words: Words, base: int = WINDOW_BASE) -> np.ndarray:
    return spans(words.buf.astype(np.uint64) + np.uint64(1), words.start, words.end, base)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Indices of words at which `size` words of one document begin."""
    doc = words.doc
    n = len(doc) - size + 1
    return np.flatnonzero(doc[:n] == doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int, base: int) -> np.ndarray:
    return spans(hashes, first, first + size, base)
