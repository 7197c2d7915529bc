"""Secrets in texts: keywords by an Aho-Corasick automaton, regular expressions only where one was met, checksums last.

One automaton of all keywords runs over the bytes of a batch of texts at once, in lower case. A rule's expression is tried
at the places of its own keywords only, anchored there, and never across the end of a text. Runs of hex digits begin with no
keyword: a run of `HEX` digits or more covers two probes in a row when every (HEX // 2)th byte is probed, so the
expression is tried only around those. Matches of one rule do not overlap: the leftmost begins, and the search goes on
behind it, even where the match fails the rule's test of length. What must carry a checksum is kept only if it is right.

Rules: `assign` (a named value), `access` (an access key's id), `hex` (a long digit run), and two kinds of tokens whose last
six characters are the crc32 of the thirty before them in base 62: `code` (code hosting) and `registry` (package registry).
No rows move: each batch of rows is scanned where it is read, so a hot source or a group of copies changes nothing.

Results for odd input: null texts count as empty and have no spans; a text of any length is scanned whole; rows that repeat an id
or a text are rows of their own; an empty table gives an empty one; other columns stay as they are in `find_secrets` and
`redact`, whatever their names (an added column replaces one of its name). Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import widened
from .words import _LOWER, pieces_of, text_bytes

HEX = 32
ALPHABET = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PIECE = 8 << 20
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
SPANS = "array<struct<kind: string, start: bigint, `end`: bigint>>"


def checked(token: bytes) -> bool:
    """Whether a token is a prefix of four characters, thirty more, and the crc32 of the thirty as six digits of base 62."""
    crc, digits = zlib.crc32(token[4:34]), bytearray()
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits.append(ALPHABET[d])
    return len(token) == 40 and bytes(digits[::-1]) == token[34:]


@dataclass(frozen=True)
class Rule:
    """`keywords` (lower case) stand at the beginning of each match of `pattern`; `test` judges a match."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    test: Callable[[re.Match], bool]


# The rules' expressions, and the prefixes of tokens.
BASE = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: m.end(2) - m.start(2) >= 8),
    Rule("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 16),
    Rule("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: m.end() - m.start() >= HEX),
)
TOKENS = (
    Rule("code", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]+"), lambda m: checked(m.group())),
    Rule("registry", ("npm_",), re.compile(rb"npm_[A-Za-z0-9]+"), lambda m: checked(m.group())),
)
RULES = BASE + TOKENS


def automaton(rules: tuple[Rule, ...]) -> ahocorasick.Automaton:
    """Each keyword with its length and the number of its rule."""
    made = ahocorasick.Automaton()
    for i, rule in enumerate(rules):
        for word in rule.keywords:
            made.add_word(word, (i, len(word)))
    made.make_automaton()
    return made


def hex_places(buf: np.ndarray) -> np.ndarray:
    """Where runs of hex digits begin that cover two probes in a row (and the quarters between them)."""
    step = HEX // 2
    at = np.arange(0, max(len(buf) - step, 0), step)
    for between in (0, step, step // 2, step // 4, 3 * step // 4):
        at = at[_HEX[buf[at + between]]]
    first = at.copy()  # a run begins less than a step before its first two probes
    for _ in range(step - 1):
        first -= (first > 0) & _HEX[buf[np.maximum(first - 1, 0)]]
    return np.unique(first)


def scan(texts: pa.Array, rules: tuple[Rule, ...], words: ahocorasick.Automaton) -> list[list[tuple[int, int, int]]]:
    """For each text, (start, number of the rule, end) of all that the rules find, in order."""
    buf, offset = text_bytes(texts)
    raw = buf.tobytes()
    places: list[list[int]] = [[] for _ in rules]
    for last, (i, n) in words.iter(_LOWER[buf].tobytes().decode("latin-1")):
        places[i].append(last - n + 1)
    starts = offset[:-1][(offset[:-1] > 0) & (offset[:-1] < len(buf))]
    starts = starts[_HEX[buf[starts]] & _HEX[buf[starts - 1]]]  # a run over the end of a text begins anew in the next
    for i, rule in enumerate(rules):
        if not rule.keywords:
            places[i] = [*hex_places(buf).tolist(), *starts.tolist()]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offset) - 1)]
    for i, rule in enumerate(rules):
        free = 0
        at = np.unique(np.array(places[i], np.int64))
        docs = np.searchsorted(offset, at, "right") - 1
        for place, doc in zip(at.tolist(), docs.tolist()):
            if place >= free and doc < len(found) and (m := rule.pattern.match(raw, place, int(offset[doc + 1]))):
                free = m.end()
                if rule.test(m):
                    found[doc].append((m.start() - int(offset[doc]), i, m.end() - int(offset[doc])))
    for doc, spans in enumerate(found):
        if spans:
            own = buf[offset[doc] : offset[doc + 1]]
            points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # bytes that begin a code point
            found[doc] = sorted((int(points[a]), i, int(points[b])) for a, i, b in spans)
    return found


def _column(spans: list[list[tuple[int, int, int]]], kinds: list[str]) -> pa.Array:
    flat = [x for row in spans for x in row]
    fields = [pa.array([kinds[i] for _, i, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for *_, b in flat], pa.int64())]
    ends = np.concatenate([[0], np.cumsum([len(row) for row in spans])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))


def _per_text(df: DataFrame, name: str, ddl: str, make: Callable[[pa.Array], pa.Array], drop_text: bool) -> DataFrame:
    """`df` with one more column made from `text`; batches are cut into pieces of bounded size."""
    rest = df.drop(name)
    schema = widened(rest.drop("text").schema if drop_text else rest.schema, **{name: ddl})
    size = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch["text"], size):
                piece = batch.slice(part.start, part.stop - part.start)
                columns = [c for n, c in zip(piece.schema.names, piece.columns) if not drop_text or n != "text"]
                yield pa.RecordBatch.from_arrays([*columns, make(piece["text"])], names=schema.names)

    return rest.mapInArrow(run, schema)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_text: bool = True) -> DataFrame:
    """The documents with `secrets`: kind, start and end of each, ordered by start, then by kind as the rules stand."""
    kinds, words = [r.kind for r in rules], []

    def make(texts: pa.Array) -> pa.Array:
        if not words:
            words.append(automaton(rules))
        return _column(scan(texts, rules, words[0]), kinds)

    return _per_text(docs, "secrets", SPANS, make, not keep_text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """The documents with every secret in their text replaced by `mask`; secrets that overlap or touch are replaced as one."""
    columns, words = docs.columns, []

    def make(texts: pa.Array) -> pa.Array:
        if not words:
            words.append(automaton(rules))
        out = []
        for text, spans in zip(texts.to_pylist(), scan(texts, rules, words[0])):
            parts, at = [], 0
            for a, _, b in spans:
                if a > at or not parts:
                    parts += [text[at:a], mask]
                at = max(at, b)
            out.append(text if text is None else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return _per_text(docs, "__redacted", "string", make, True).withColumnRenamed("__redacted", "text").select(*columns)


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base rules, the digest of their spans, and all spans as text."""
    found = find_secrets(docs.select("doc_id", "text"), keep_text=False)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def _spans_sql(number: int, kind: str, pattern: str) -> str:
    """Matches and what stands between them give the places: each begins after all that stand before it."""
    return f"""SELECT doc_id, {number} AS ord, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(coalesce(list_sum(list_transform(p[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS a, unnest(m) AS s
       FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, string_split_regex(text, {pattern}) AS p FROM d)"""


def _letters(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def secrets_sql() -> str:
    from .resample import CRC_SQL, crc_sql

    words = "|".join([*map(_letters, ("password", "passwd", "secret", "token")), _letters("api") + "_?" + _letters("key")])
    assign = f"""'(?:{words})["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+'"""
    value = f"""length(regexp_extract(s, '^(?:{words})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8"""
    digits = " || ".join(f"substr('{ALPHABET.decode()}', CAST(crc // {62**k} % 62 AS INT) + 1, 1)" for k in range(5, -1, -1))
    return f"""
WITH {CRC_SQL}, d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_spans_sql(0, 'assign', assign)} UNION ALL {_spans_sql(1, 'access', "'AKIA[A-Z0-9]{12,}'")} UNION ALL {_spans_sql(2, 'hex', "'[0-9a-f]{32,}'")}
      UNION ALL {_spans_sql(3, 'code', "'gh[pousr]_[A-Za-z0-9]+'")} UNION ALL {_spans_sql(4, 'registry', "'npm_[A-Za-z0-9]+'")}),
long AS (SELECT * FROM f WHERE CASE ord WHEN 0 THEN {value} WHEN 1 THEN true WHEN 2 THEN true ELSE length(s) = 40 END),
ok AS (SELECT *, kind || ':' || a || ':' || (a + length(s)) AS t FROM (SELECT *, CASE WHEN ord > 2 THEN {crc_sql('substr(s, 5, 30)')} END AS crc FROM long, crc_table) WHERE ord <= 2 OR {digits} = substr(s, 35, 6))
SELECT d.doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
       sha256(coalesce(string_agg(t, ',' ORDER BY a, ord) FILTER (ord <= 2), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY a, ord), '') AS spans
FROM d LEFT JOIN ok USING (doc_id) GROUP BY d.doc_id
"""
