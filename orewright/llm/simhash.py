"""SimHash near-dedup through a byte-position inverted index.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits differ in at most three
bytes, so they share at least five of the eight: the guaranteed minimum. One half of the positions (0-3 or 4-7) then
has at most one differing byte, so the pair shares three positional bytes of one half; the index therefore has one
posting list for each three positional bytes of a half (eight keys per fingerprint). Within a list the shared
positional bytes are tallied, pairs below the minimum are dropped, and the rest are verified by their differing bits.

A posting list longer than `HOT` is split by two more shared positional bytes (a pair that qualifies shares at least
two of the five left), and what is longer still by half bytes, which leaves at most 4096 different fingerprints in a list
whatever the data. Equal fingerprints are one entry of the index. A list's links come out as a spanning forest, not as pairs: a component needs
no more, and a group of m near copies makes fewer than m rows per list.

Results for odd input: null and empty texts have the fingerprint zero and link to each other; texts of fewer words
than a shingle are one shingle; equal fingerprints link; rows that repeat a doc_id each get a row, with one component;
a null doc_id joins its fingerprint's group, and is its component's id only if no other id is there; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, components, contracted, cut, split_off
from .words import SECOND_BASE, mix, pieces_of, spans, window_hashes, window_starts, word_hashes, words_of

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_BYTES = 5
HOT = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        pieces = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pieces), np.uint64, len(words) - shingle + 1)
    set_bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65536):
        block = hashes[part : part + 65536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch["text"]], np.uint64)
            yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "fp": pa.array(fps.view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _joined(positions: tuple[int, ...], number: int) -> Column:
    """The values at some positions and the number of that set of positions, as one long."""
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _thirds() -> Column:
    """For every three of the six half bytes at the positions that `t` and `pair` leave: their number and their values, as 12 bits."""
    left = []
    for triple in TRIPLES:
        rest = [p for p in range(8) if p not in triple]
        left.append([[p for p in rest if p not in pair] for pair in combinations(rest, 2)])
    bits = F.expr(f"element_at(element_at({_sql_array(left)}, t + 1), pair + 1)")
    halves = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.call_function("shiftrightunsigned", F.col("fp"), 8 * F.element_at(bits, (F.floor(c / 2) + 1).cast("int")) + 4 * (c % 2)).bitwiseAND(F.lit(15).cast("long")))
    half = lambda h, i: F.element_at(h, i)
    choices = F.expr(_sql_array([[i + 1 for i in c] for c in combinations(range(6), 3)]))
    joined = lambda h, c: F.shiftleft(F.shiftleft(half(h, c[0]), 4).bitwiseOR(half(h, c[1])), 4).bitwiseOR(half(h, c[2]))
    made = lambda h: F.transform(choices, lambda c, i: F.struct(i.alias("three"), joined(h, c).alias("more")))
    return F.get(F.transform(F.array(halves), made), F.lit(0))  # the half bytes are a lambda's variable, so worked out once


def _sql_array(x) -> str:
    return f"array({', '.join(map(_sql_array, x))})" if isinstance(x, list) else str(x)


def posting_lists(entries: DataFrame, hot: int = HOT) -> DataFrame:
    """Lists of (rep, fp) that share enough positional bytes to hold every qualifying pair; only lists of two or more.

    A list of more than `hot` entries is split by two more of the bytes that a qualifying pair shares. What is longer still has five
    bytes in common; of the six half bytes left at most three differ in a pair, so it is split by every three of them. Then
    twelve bits are left free, so no list of different fingerprints has more than 4096 entries, whatever the input."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _joined(t, i).alias("key")) for i, t in enumerate(TRIPLES)]))
    keyed = entries.select("rep", "fp", keys.alias("k")).select("rep", "fp", "k.t", "k.key", F.lit(-1).alias("pair"), F.lit(-1).alias("three"))
    at, columns = ["pair", "three", "key"], ["rep", "fp", "t", "key", "pair", "three"]

    def heavy(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        return split_off(rows, cut(rows.groupBy(*at).count().where(F.col("count") > hot).select(*at)), at, "rep")

    cold, long = heavy(keyed)
    lists = [cold.select(*columns)]
    if long is not None:
        finer = []
        for triple in TRIPLES:
            rest = [p for p in range(8) if p not in triple]
            finer.append(F.array(*[F.struct(F.lit(j).alias("pair"), _joined(p, 0).alias("more")) for j, p in enumerate(combinations(rest, 2))]))
        split = long.select("rep", "fp", "t", "key", "three", F.explode(F.element_at(F.array(*finer), F.col("t") + 1)).alias("s"))
        cold, long = heavy(split.select("rep", "fp", "t", F.shiftleft("key", 16).bitwiseOR(F.col("s.more")).alias("key"), "s.pair", "three"))
        lists.append(cold.select(*columns))
    if long is not None:
        split = long.select("rep", "fp", "t", "key", "pair", F.explode(_thirds()).alias("s"))
        lists.append(split.select("rep", "fp", "t", F.shiftleft("key", 12).bitwiseOR(F.col("s.more")).alias("key"), "pair", "s.three").select(*columns))
    every = reduce(DataFrame.unionByName, lists).groupBy(*at).agg(F.collect_list(F.struct("rep", "fp")).alias("entries"))
    return every.where(F.size("entries") > 1).select("entries")


def forest(rep: np.ndarray, fp: np.ndarray, max_bits: int, min_bytes: int) -> list[tuple[int, int]]:
    """Links that connect what the qualifying pairs of one posting list connect."""
    links, left = [], np.argsort(rep, kind="stable")  # stars at the least entry: lists of one group then agree on most links
    while len(left):
        root, frontier, left = int(rep[left[0]]), [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            differ = fp[left] ^ fp[node]
            tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= min_bytes
            near[near] = np.bitwise_count(differ[near]) <= max_bits
            reached = left[near]
            links += [(root, int(rep[x])) for x in reached]
            frontier += reached.tolist()
            left = left[~near]
    return links


def near_links(entries: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Links (u, v) between the representatives of different fingerprints that differ in at most `max_bits` bits."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the index guarantees {MIN_BYTES} shared bytes up to {MAX_BITS} differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["entries"]
            inner = lists.flatten()
            rep, fp = inner.field("rep").to_numpy(), inner.field("fp").to_numpy().view(np.uint64)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            links = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                links += forest(rep[a:b], fp[a:b], max_bits, 8 - max_bits)
            u, v = zip(*links) if links else ((), ())
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return posting_lists(entries, hot).mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable by links.

    What is linked are fingerprints, so texts that share an id, or have none, are told apart; component_id is null only
    where no text of a component has an id."""
    made = cut(fingerprints(docs, shingle))
    entries = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut(components(near_links(entries.select(F.col("fp").alias("rep"), "fp"), max_bits, hot)))
    own = F.col("fp") == F.col("node")
    firsts = cut(linked.join(entries.hint("merge"), own).groupBy("component").agg(F.min("least").alias("first")))
    reached = attach(linked, firsts, ["component"], "node", 32).select("node", "first")
    groups = entries.join(reached.hint("merge"), own, "left").select("fp", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return made.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, less those whose group has a smaller doc_id."""
    return _first_of(docs, simhash_groups(docs, **how))


def _first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    drop = groups.where("doc_id != component_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, F.col("doc_id") == F.col("__drop"), "left_anti")


# Similarity well below "three bits of 64" needs a longer fingerprint: 64 positional bytes instead of eight.

WORDS64 = 8
SIMILAR = 0.8
#: Offsets of the positions of a key's second and third byte from its first, which runs over all positions.
KEY_SHAPES = ((1, 3), (5, 16), (7, 26), (11, 29), (4, 13), (6, 20))
#: Sets of so few shingles meet under their least hashes too: of two at 0.8, a fifth and one more of each surely share one.
FEW = 20
FEW_BITS = 160
FEW_KEY = 1 << 62
#: Positional bytes that a pair of one list shares at least.
MIN_SHARED = 3
#: Entries of a list, or of a block of a longer one, that one task compares.
LIST = 8192
#: Shingle hashes that a block of an exact comparison holds.
BLOCK_HASHES = 1 << 20
PIECE_BYTES = 1 << 20
#: Words of a fingerprint of which the first that a key does not touch (it touches three at most) is the mark of the key's rows.
MARKS = (0, 4, 2, 6)
#: Fingerprints of which the keys are made at once.
KEYED = 2048
#: Kinds of lists: whole ones, blocks of long ones with their hub, and entries that ask with a block of entries.
COLD, BLOCK, MEET = 0, 1, 2
NO_KEY = -1
#: One of so many choices of positions comes first.
EARLY = 16
#: Rows of a block of an exact comparison.
EXACT_BLOCK = 512
_OFFSETS = np.array([i * SECOND_BASE % (1 << 64) for i in range(WORDS64)], np.uint64)


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The set of each text's shingles: sorted hashes; a text of fewer words is one shingle, one without words has none."""
    for piece in pieces_of(texts, PIECE_BYTES):
        words = words_of(texts[piece], lower=True)
        hashes = word_hashes(words)
        first = window_starts(words, shingle)
        made = window_hashes(hashes, first, shingle, SECOND_BASE)
        whole = spans(hashes, words.ptr[:-1], words.ptr[1:], SECOND_BASE)
        ends = np.searchsorted(first, words.ptr)
        for d, (a, b, n) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), np.diff(words.ptr).tolist())):
            yield np.unique(made[a:b]) if n >= shingle else whole[d : d + (n > 0)]


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """A SimHash of 512 bits; each shingle's hash is mixed into eight."""
    set_bits = np.zeros(512, np.int64)
    for part in range(0, len(hashes), 2048):
        made = mix(hashes[part : part + 2048, None] + _OFFSETS)
        bits = np.unpackbits(made.view(np.uint8), bitorder="little").reshape(-1, 512)
        for begin in range(0, len(bits), 255):  # as many bits as a byte can count
            set_bits += bits[begin : begin + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(set_bits * 2 > len(hashes), bitorder="little").tobytes()


def max_distance(similarity: float) -> int:
    """Differing bits that few fingerprints of sets at this Jaccard similarity pass: their average and four deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(512 * share + 4 * math.sqrt(512 * share * (1 - share)))


def mark_distance(similarity: float) -> int:
    """Differing bits that marks of sets at this Jaccard similarity all but never pass: their average and five deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * share + 5 * math.sqrt(64 * share * (1 - share)))


def similar_links(entries: DataFrame, similarity: float, hot: int = LIST, more: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that connect the representatives whose fingerprints differ in no more bits than `max_distance`;
    found where three positional bytes agree, under any of 384 choices of positions. more: other keys (rep, key) of
    sets too small for the fingerprints' averages; under these, twice as far above the average is near.

    A few of the choices come first, and what shares of their links connect are known groups; under the other choices only lists of
    more than one group are looked at, and only for links between groups. So a group of many near copies, which meets
    under every choice, is linked once and not 384 times. A list of more than `hot` entries is cut into blocks, and its
    hub (the entry that stands in most lists) joins each: what is near the hub is linked there. The others of a block are
    linked among themselves and then meet every entry of the list, block against block.
    """
    most = max_distance(similarity)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = batch["entries"].flatten()
            rep, degree, grp, asks = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "degree", "grp", "asks"))
            fp = np.frombuffer(b"".join(inner.field("fp").to_pylist()), np.uint64).reshape(-1, WORDS64)
            few, length = batch["key"].to_numpy() >= FEW_KEY, pc.list_value_length(batch["entries"]).to_numpy()
            kind, end = batch["kind"].to_numpy(), np.cumsum(length)
            # Most lists are pairs: these are decided at once.
            pair = (length == 2) & (kind == COLD)
            one, two = end[pair] - 2, end[pair] - 1
            differ = fp[one] ^ fp[two]
            near = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= np.where(few[pair], FEW_BITS, most)
            near &= few[pair] | ((differ.view(np.uint8) == 0).sum(axis=1) >= MIN_SHARED)
            u, v, key = [np.minimum(rep[one[near]], rep[two[near]])], [np.maximum(rep[one[near]], rep[two[near]])], [np.full(near.sum(), NO_KEY)]
            for k in np.flatnonzero(~pair):
                part = slice(end[k] - length[k], end[k])
                order = np.lexsort((rep[part], -degree[part]))
                bounds = (FEW_BITS, 0) if few[k] else (most, MIN_SHARED)
                found, rest = wide_forest(rep[part][order], fp[part][order], *bounds, grp[part][order], asks[part][order] if kind[k] == MEET else None)
                u += [np.array([x[0] for x in found], np.int64), np.array(rest if kind[k] == BLOCK else [], np.int64)]
                v += [np.array([x[1] for x in found], np.int64), u[-1]]
                key += [np.full(len(found), NO_KEY), np.full(len(u[-1]), batch["key"][int(k)].as_py())]
            yield pa.record_batch({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64()), "key": pa.array(np.concatenate(key), pa.int64())})

    def linked(rows: DataFrame, kind: int, *by: str) -> DataFrame:
        entry = F.struct("rep", "fp", "degree", "grp", "asks")
        lists = rows.groupBy("key", *by).agg(F.collect_list(entry).alias("entries")).where(F.size("entries") > 1)
        return lists.select("key", "entries", F.lit(kind).alias("kind")).mapInArrow(link, "u long, v long, key long")

    def links_of(rows: DataFrame) -> DataFrame:
        """Links of the lists of some keys; rows: key, count, rep, fp, degree, grp, asks."""
        cold = linked(rows.where(F.col("count") <= hot), COLD).select("u", "v")
        long = cut(rows.where(F.col("count") > hot).withColumn("blocks", F.ceil(F.col("count") / hot).cast("int")))
        if long.isEmpty():
            return cold
        hub = F.max_by(F.struct("rep", "fp", "degree", "grp"), F.struct("degree", -F.col("rep")))
        hubs = cut(long.groupBy("key", "blocks").agg(hub.alias("hub")))
        block = F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int").alias("block")
        columns = ["key", "rep", "fp", "degree", "grp", "asks"]
        own = attach(long, hubs.select("key", F.col("hub.rep").alias("hub")), ["key"], "rep", 64).where("rep <> hub").select(*columns, block)
        each = hubs.select("key", "hub.*", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = cut(linked(own.unionByName(each), BLOCK, "block"))
        # What is not near its hub meets every entry of its list.
        rest = found.where(F.col("key") != NO_KEY).select("key", F.col("u").alias("rep")).distinct()
        parts = cut(rest.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")))
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
        asked = attach(long.drop("asks").join(rest.hint("merge"), ["key", "rep"]), parts, ["key"], "rep", 64)
        asking = asked.select("key", "rep", "fp", "degree", "grp", F.lit(True).alias("asks"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), every("blocks", "block"))
        held = attach(long, parts, ["key"], "rep", 64).select("key", "rep", "fp", "degree", "grp", F.lit(False).alias("asks"), every("parts", "part"), block)
        met = linked(asking.unionByName(held), MEET, "part", "block")
        return cold.unionByName(found.where(F.col("key") == NO_KEY).select("u", "v")).unionByName(met.select("u", "v")).where("u <> v")

    # A fingerprint's keys stay with it in one row, so that no join has a row for each key.
    met = met_keys(entries, similarity, more).groupBy("rep").agg(F.collect_list(F.struct("key", "count")).alias("keys"))
    held = cut(met.select("rep", F.size("keys").cast("long").alias("degree"), "keys").join(entries.select("rep", "fp").hint("merge"), "rep"))
    early = lambda x: F.pmod(F.shiftright(x.key, 24), F.lit(EARLY)) == 0
    columns = ["key", "count", "rep", "fp", "degree"]
    now = held.select("rep", "fp", "degree", F.explode(F.filter("keys", early)).alias("k")).select("k.*", "rep", "fp", "degree")
    first = cut(links_of(now.select(*columns, F.col("rep").alias("grp"), F.lit(True).alias("asks"))).distinct())
    # Groups need not be whole, as links between groups are looked for anyway.
    groups = contracted(first).groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("grp"))
    known = cut(held.select("rep", "fp", "degree").join(groups.hint("merge"), "rep", "left").withColumn("grp", F.coalesce("grp", "rep")))
    later = held.select("rep", F.filter("keys", lambda x: ~early(x)).alias("keys")).join(known.select("rep", "grp").hint("merge"), "rep")
    spread = later.select("rep", "grp", F.explode("keys").alias("k")).select("k.*", "rep", "grp")
    mixed = cut(spread.groupBy("key").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).where("least <> most").select("key"))
    open_ = attach(spread.select("key", "count", "rep"), mixed, ["key"], "rep", 32)
    late = links_of(open_.join(known.hint("merge"), "rep").select(*columns, "grp", F.lit(True).alias("asks")))
    return first.unionByName(late).distinct()


def met_keys(entries: DataFrame, similarity: float, more: DataFrame | None = None) -> DataFrame:
    """rep, key and count of the keys that several entries have, less the pairs whose marks are too far apart.

    Three bytes also agree by chance, mostly in lists of two, and such lists grow with the square of the table. Marks that
    met by chance differ in half of their 64 bits; of pairs at 0.8 fewer than one in 100,000 has marks over the bound."""
    size = 8 * WORDS64
    first = np.arange(size)
    at = np.concatenate([np.stack([first, (first + a) % size, (first + b) % size]) for a, b in KEY_SHAPES], axis=1)
    word = np.array([next(w for w in MARKS if w not in touched) for touched in (at // 8).T.tolist()])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(begin, KEYED) for begin in range(0, len(batch), KEYED)):
                raw = np.frombuffer(b"".join(part["fp"].to_pylist()), np.uint8).reshape(-1, size)
                fp = raw.astype(np.int64)
                made = fp[:, at[0]] | fp[:, at[1]] << 8 | fp[:, at[2]] << 16 | np.arange(len(word)) << 24
                marks = raw.view(np.int64)[:, word]
                yield pa.record_batch({"rep": pa.array(np.repeat(part["rep"].to_numpy(), len(word))), "key": pa.array(made.ravel()), "mark": pa.array(marks.ravel())})

    keyed = entries.select("rep", "fp").mapInArrow(keys, "rep long, key long, mark long")
    if more is not None:
        keyed = keyed.unionByName(more.withColumn("mark", F.lit(0).cast("long")))
    own = Window.partitionBy("key")
    counted = keyed.withColumn("count", F.count("*").over(own)).withColumn("apart", F.bit_count(F.bit_xor("mark").over(own)))
    return counted.where(f"count > 2 or count = 2 and apart <= {mark_distance(similarity)}").select("rep", "key", "count")


def wide_forest(rep: np.ndarray, fp: np.ndarray, most: int, min_bytes: int, grp: np.ndarray, asks: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect the groups of one list of which some fingerprints share `min_bytes` positional bytes and differ
    in `most` bits at most, as stars around the first of each component; and the entries that are neither near the list's
    first nor of its group. With `asks`, only pairs of which one asks are looked at."""
    links, rest, left = [], [], np.arange(len(rep))
    while len(left):
        first, frontier, left = left[0], [left[0]], left[1:]
        joined = {int(grp[first])}
        while frontier and len(left):
            node = frontier.pop()
            differ = fp[left] ^ fp[node]
            near = (differ.view(np.uint8) == 0).sum(axis=1) >= min_bytes
            near &= np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most
            if asks is not None:
                near &= asks[left] | asks[node]
            near |= grp[left] == grp[node]
            reached = left[near]
            for x in reached.tolist():
                if int(grp[x]) not in joined:
                    joined.add(int(grp[x]))
                    links.append((int(rep[first]), int(rep[x])))
            frontier += reached.tolist()
            left = left[~near]
            if node == 0:
                rest = rep[left].tolist()
    return links, rest


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets is at least `similarity`."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def exact_links(sets: DataFrame, similarity: float, hot: int = EXACT_BLOCK) -> DataFrame:
    """Links (u, v) that connect what the pairs of one group with a Jaccard value of `similarity` connect.

    sets: grp (the least node of the group), node, set (sorted hashes, as bytes) and n. A group is first compared with
    its least node, then what is not like that node with every member, block against block. Members that are like the
    least node are connected already and are not compared among themselves.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["set"].to_pylist(), batch["hub"].to_pylist())
            ok = [alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in pairs]
            yield pa.record_batch({"grp": batch["grp"], "node": batch["node"], "ok": pa.array(ok, pa.bool_())})

    def cross(t: pa.Table) -> pa.Table:
        u, v = cross_links(t, similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        needed = F.ceil(F.greatest(F.count("*") / hot, F.sum("n") / BLOCK_HASHES)).cast("int")
        return rows.groupBy("grp").agg(F.greatest(needed, F.lit(1)).alias(name))

    def part(name: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(name)).cast("int")

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    parts = cut(blocks(sets, "parts"))
    hubs = sets.where("node = grp").join(parts.hint("merge"), "grp").select("grp", F.col("set").alias("hub"), every("parts").alias("part"))
    shared = sets.where("node != grp").join(parts.hint("merge"), "grp").select("grp", "node", "set", part("parts").alias("part"))
    star = cut(shared.join(hubs.hint("merge"), ["grp", "part"]).select("grp", "node", "set", "hub").mapInArrow(compare, "grp long, node long, ok boolean"))
    rest = sets.join(star.where("not ok").select("node").hint("merge"), "node", "left_semi")
    todo = cut(blocks(rest, "rests").join(parts.hint("merge"), "grp"))
    known = star.where("ok").select("node", F.lit(True).alias("known"))
    asking = rest.join(todo.hint("merge"), "grp").select("grp", "node", "set", F.lit(False).alias("known"), F.lit(True).alias("asks"), part("rests").alias("i"), every("parts").alias("j"))
    held = sets.join(todo.hint("merge"), "grp").join(known.hint("merge"), "node", "left").select("grp", "node", "set", F.coalesce("known", F.col("node") == F.col("grp")).alias("known"), F.lit(False).alias("asks"), every("rests").alias("i"), part("parts").alias("j"))
    found = asking.unionByName(held).groupBy("grp", "i", "j").applyInArrow(cross, "u long, v long")
    return star.where("ok").select(F.col("grp").alias("u"), F.col("node").alias("v")).unionByName(found)


def cross_links(t: pa.Table, similarity: float) -> tuple[list[int], list[int]]:
    """Links between the rows that ask and all rows of a block, fewer than rows; rows known to be alike are one from the start."""
    node, asks, known = t["node"].to_numpy(), t["asks"].to_numpy(), t["known"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
    size = np.array([len(x) for x in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    _, label = np.unique(node, return_inverse=True)  # a row that asks is in its block a second time
    label = np.where(known, -1, label)
    u, v = [], []
    for i in np.flatnonzero(asks):
        lo, hi = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
        lengths = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for x in np.flatnonzero((both >= similarity * (size + size[i] - both) - 1e-9) & (both > 0)):
            if label[x] != label[i]:
                u.append(int(node[i]))
                v.append(int(node[x]))
                label[label == label[x]] = label[i]
    return u, v


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = SIMILAR, hot: int = LIST) -> DataFrame:
    """doc_id, text_md5 and `least`, the doc_id (nulls last) and text_md5 of the first document of its component: documents
    linked by a Jaccard value of their sets of shingle hashes of `similarity` or more.

    The fingerprints' index finds candidates by a looser bound; the sets of those alone are then compared exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"], shingle))
            few = [x[: len(x) // 5 + 1].view(np.int64) & (FEW_KEY - 1) | FEW_KEY if len(x) <= FEW else [] for x in sets]
            made = {
                "doc_id": batch["doc_id"].cast(pa.int64()),
                "text_md5": batch["text_md5"],
                "fp": pa.array([wide_fingerprint(x) for x in sets], pa.binary()),
                "digest": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                "n": pa.array([len(x) for x in sets], pa.int64()),
                "few": pa.array(few, pa.list_(pa.int64())),
            }
            yield pa.record_batch(made)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(batch["text"], shingle)]
            yield pa.record_batch({"grp": batch["grp"], "node": batch["node"], "n": batch["n"], "set": pa.array(sets, pa.binary())})

    keyed = docs.select("doc_id", F.md5("text").alias("text_md5"), "text")
    schema = "doc_id long, text_md5 string, fp binary, digest binary, n long, few array<long>"
    made = cut(keyed.mapInArrow(run, schema))
    # Equal sets are one entry. Nodes are numbers of entries, as ids may be null or stand at several texts.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("least")
    entries = made.groupBy("digest").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("few").alias("few"), least)
    entries = cut(entries.withColumn("rep", F.monotonically_increasing_id()))
    few = entries.select("rep", F.explode("few").alias("key"))
    loose = cut(components(similar_links(entries, similarity, hot, few)).select("node", F.col("component").alias("grp")))
    asked = loose.join(entries.hint("merge"), F.col("rep") == F.col("node")).select("grp", "node", "n", "least.doc_id", "least.text_md5")
    same = F.col("a.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("a.text_md5").eqNullSafe(F.col("k.text_md5"))
    texts = keyed.alias("k").join(asked.alias("a").hint("merge"), same).select("grp", "node", "n", "text")
    sets = cut(texts.mapInArrow(read, "grp long, node long, n long, set binary").dropDuplicates(["node"]))
    linked = components(exact_links(sets, similarity, min(hot, EXACT_BLOCK)))
    groups = entries.join(linked.hint("merge"), entries.rep == linked.node, "left").select("digest", "least", F.coalesce("component", "rep").alias("component"))
    firsts = groups.groupBy("component").agg(F.min("least").alias("least"))
    return made.join(groups.select("digest", "component").hint("merge"), "digest").join(firsts.hint("merge"), "component").select("doc_id", "text_md5", "least")


def similar_dedup(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns, one row of each group of similar documents: the one with the smallest doc_id (nulls
    last) and then the least hash of its text, whether or not other rows repeat its doc_id."""
    same = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("text_md5").eqNullSafe(F.col("least.text_md5"))
    groups = similar_groups(docs, **how)
    drop = groups.where(~same).select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    # Rows alike in both are one text, of which one row stays.
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").alias("__key"), F.md5("text").alias("__hash"))
    left = rows.join(drop, F.col("__key").eqNullSafe(F.col("__id")) & F.col("__hash").eqNullSafe(F.col("__md5")), "left_anti")
    number = F.row_number().over(Window.partitionBy("__key", "__hash").orderBy("__key"))
    return left.withColumn("__number", number).where("__number = 1").select("__doc.*")
