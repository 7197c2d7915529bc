"""Byte-level BPE through a trie of distinct words.

A word's encoding is fixed by the last token of each of its prefixes: the last token t of a prefix is the one token
that ends it for which the last token of what stands before t stays next to t, that is, BPE would not merge across
the seam. So every trie node holds one number, its prefix's last token; words share the nodes of shared prefixes, and
each node is worked out once, depth first, from its ancestors. A word is read off by following last tokens backwards.

Each task keeps one trie for the distinct words of its documents (`MAX_NODES` bounds it: a full trie is dropped and
grown anew, which changes no result). Nothing is shuffled, so copies, hot sources and hot words cost nothing extra.

Results for odd input: null and empty texts have no tokens and decode to the empty text; a special token's string in
a text is that token, as in the tokenizer file; very long texts and words are encoded whole; rows that repeat a
doc_id each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import widened
from .words import pieces_of

MAX_NODES = 600_000
#: Fixed: the word pattern of byte-level BPE of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern spelled out for texts without characters from U+0250 on, for the faster standard module.
_LETTER, _DIGIT, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
_ROOT, _NONE = 0, -1


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        self.path = path
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Pair of ids, as one number -> its merge's rank; id -> its own merge's rank and parts (single bytes: rank -1).
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right = self.ids[raw(a)], self.ids[raw(b)]
            self.rank[left << 32 | right] = r
            self.made.setdefault(self.ids[raw(a + b)], (r, left, right))
        self.sizes = {i: len(b) for i, b in self.tokens.items()}
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.edges: dict[int, dict[int, list]] = {1: {}, 2: {}}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.last: list[int] = [_NONE]
        self.before: list[int] = [_NONE]  # the node at which the last token begins
        #: Words worked out so far; a special token's string is no word and has its own id.
        self.encoded: dict[str, list[int]] = {s: [i] for s, i in self.special.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """Tokens at one edge of `token`, outermost merge first: token, rank at which it arises, rank at which it ends."""
        out, ends, inner = [], float("inf"), token
        while inner in self.made:
            r = self.made[inner][0]
            out.append((inner, r, ends))
            inner, ends = self.made[inner][side], r
        return self.edges[side].setdefault(token, [*out, (inner, -1, ends)])

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side. At equal rank the leftmost pair merges first."""
        rank, right_edge = self.rank.get, self.edges[1].get(right) or self._edge(right, 1)
        for x, x_from, x_to in self.edges[2].get(left) or self._edge(left, 2):
            for y, y_from, y_to in right_edge:
                r = rank(x << 32 | y)
                if r is not None and x_from < r < x_to and y_from < r <= y_to:
                    return False
        return True

    def _grow(self, words: Iterable[bytes]) -> None:
        """Insert words into the trie and give each new node its last token, parents before children.

        Exactly one token can be last, so the sizes may be tried in any order: one byte more than the parent's last
        token comes first, as it is right most often.
        """
        child, last, before, ids, stays, sizes = self.child, self.last, self.before, self.ids, self.stays, self.sizes
        for word in sorted(words):  # sorted: a depth-first walk of the trie
            path, node = [_ROOT], _ROOT
            for depth, byte in enumerate(word, 1):
                edge = node << 8 | byte
                parent, node = node, child.get(edge)
                if node is None:
                    node = child[edge] = len(last)
                    likely = sizes[last[parent]] + 1 if parent else 1
                    for size in chain((likely,), range(1, likely), range(likely + 1, min(self.longest, depth) + 1)):
                        token = ids.get(word[depth - size : depth])
                        if token is not None and (size == depth or stays(last[path[depth - size]], token)):
                            last.append(token)
                            before.append(path[depth - size])
                            break
                path.append(node)
            out = []
            while node:
                out.append(last[node])
                node = before[node]
            self.encoded[word.decode()] = out[::-1]

    def _words(self, text: str) -> list[str]:
        if not _BEYOND_LATIN.search(text):
            return LATIN.findall(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Characters younger than this Python's Unicode tables: only the tokenizer's own tables class them alike.
            return [text[a:b] for _, (a, b) in _library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = []
        for text in texts:
            text = text or ""
            if self.parts and self.parts.search(text):
                split.append(list(chain.from_iterable([p] if p in self.special else self._words(p) for p in self.parts.split(text) if p)))
            else:
                split.append(self._words(text))
        if len(self.last) > MAX_NODES:
            self.clear()
        self._grow(w.encode() for w in set().union(*split).difference(self.encoded))
        known = self.encoded.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", batch_bytes: int = 4 << 20) -> DataFrame:
    """The documents with one more column: the ids of each text, array<int>."""
    schema = widened(docs.schema, **{ids: "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for piece in pieces_of(batch[text], batch_bytes):
                part = batch.slice(piece.start, piece.stop - piece.start)
                made = pa.array(bpe.encode_batch(part[text].to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=schema.names)

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with one more column: the text of each list of ids (null: empty)."""
    schema = widened(encoded.schema, **{text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            made = pa.array([bpe.decode(x or ()) for x in batch[ids].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return encoded.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers) and decoded_sha256, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, digest = load(path), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for piece in pieces_of(batch["text"], batch_bytes):
                part = batch.slice(piece.start, piece.stop - piece.start)
                ids = bpe.encode_batch(part["text"].to_pylist())
                yield pa.record_batch(
                    {
                        "doc_id": part["doc_id"].cast(pa.int64()),
                        "n_tokens": pa.array(map(len, ids), pa.int64()),
                        "ids_sha256": pa.array([digest(np.array(x, "<u4").tobytes()) for x in ids]),
                        "decoded_sha256": pa.array([digest(bpe.decode(x).encode()) for x in ids]),
                    }
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
