"""Each operator against its plain definition, over nulls, empty and long texts, ties, repeated rows, empty tables and
columns with clashing names."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from orewright.llm import bpe, html, lines, packing, ppm, quality, simhash, substring, topk  # noqa: E402
from orewright.llm import embeddings as emb  # noqa: E402
from orewright.llm.queries import vocabulary_path  # noqa: E402

r = random.Random(7)
VOCABULARY = ["the", "Thing", "of", "anea", "re", "ÉTION", "x.", "and", "to", "zz"]
PASSAGE = " ".join(r.choice(VOCABULARY) + str(i % 7) for i in range(60))


def some_documents():
    texts = [None, "", "  \n\t ", "one", PASSAGE, "lead " + PASSAGE + " tail", PASSAGE.upper(), PASSAGE.replace("x.", "y"), PASSAGE]
    texts += [" ".join(r.choice(VOCABULARY) for _ in range(r.randint(1, 80))) for _ in range(12)]
    texts += ["a\nb\nc\nd\ne", "x\nb\nc\nd\ny", "b\nc\nd", "q\nq\nq\nq\nq", "w " * 20000]
    return list(enumerate(texts))


DOCUMENTS = some_documents()
SCHEMA = "doc_id long, text string, chunk int, n int, label string"


def frame(spark, docs=DOCUMENTS, parts=3):
    return spark.createDataFrame([(i, t, 1, 2, "l") for i, t in docs], SCHEMA).repartition(parts)


def test_substring(spark):
    got = substring.substring_dedup(frame(spark), chunk_bytes=20000).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == brute.substring(DOCUMENTS)
    assert substring.substring_dedup(frame(spark, [])).count() == 0
    left = {x.doc_id: x.text for x in substring.substring_filter(frame(spark)).collect()}
    assert left[5] == "lead tail" and 8 not in left and 0 in left


@pytest.mark.parametrize("docs", [[(1, "a b c"), (2, "d e f")], [(1, None), (2, "x")], [(1, None)], [(i, "w " * i) for i in range(14)], [(i, "w " * i) for i in range(40)]])
def test_substring_of_chunks_without_windows(spark, docs):
    """Tables and chunks that hold short, null and empty texts only."""
    got = substring.substring_dedup(frame(spark, docs), chunk_bytes=40).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == brute.substring(docs)
    assert substring.substring_filter(frame(spark, docs)).columns == frame(spark, docs).columns


def test_simhash(spark):
    got = simhash.simhash_groups(frame(spark), hot=2).collect()
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got} == brute.simhash(DOCUMENTS)
    kept = simhash.similar_dedup(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = {x.doc_id for x in kept.collect()}
    assert 4 in ids and not ids & {6, 8} and 3 in ids


@pytest.mark.parametrize("hot", [2, 40, 2048])
def test_near_links_of_hot_lists_are_whole(spark, hot):
    """Fingerprints that share five bytes, so that lists are split twice: what is linked is what all pairs link."""
    rng = np.random.default_rng(4)
    low = rng.integers(0, 1 << 24, 150, np.uint64)
    near = low[:60] ^ np.array([sum(1 << int(b) for b in rng.choice(24, rng.integers(1, 4), False)) for _ in range(60)], np.uint64)
    fps = np.unique(np.concatenate([(np.uint64(0xABCDEF0123) << np.uint64(24)) | np.concatenate([low, near]), rng.integers(0, 1 << 62, 30, np.uint64)]))
    entries = spark.createDataFrame([(i, int(x.view(np.int64))) for i, x in enumerate(fps)], "rep long, fp long").repartition(3)
    from orewright.llm.common import components

    got = {(x.node, x.component) for x in components(simhash.near_links(entries, hot=hot)).collect()}
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got == {(i, x) for i, x in enumerate(label) if label.count(x) > 1} and len(got) > 100
    longest = max(len(x.entries) for x in simhash.posting_lists(entries, 2).collect())
    assert longest < 40


def test_ppm_hashes_tokens_only_where_they_are_asked_for(monkeypatch):
    """The strings of contexts and symbols come from the bytes alone."""
    calls = []
    plain = ppm.spans
    monkeypatch.setattr(ppm, "spans", lambda *a: calls.append(1) or plain(*a))
    for order in (0, 1, 5):
        for texts in ([], [None], ["", "Ab  c", "d\n\u00e9"]):
            stream = ppm.stream_of(texts, order)
            want = []
            for x in texts:
                body = b"\n" * order + b" ".join((x or "").encode().lower().split()) + b"\n"
                want += [int.from_bytes(body[i - order : i + 1], "big") for i in range(order, len(body))]
            assert ppm.strings_of(stream, order).tolist() == want
    assert not calls
    tokens, text = ppm.tokens_of(stream)
    assert calls and sorted(text.tolist()) == [0, 1, 1, 1, 2, 2, 2] and len(tokens) == 7


def test_similar_links_of_hot_lists_are_whole(spark):
    """Every pair of a long list is compared, however long a list may be before it is cut."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 64, np.uint8)
    rows = []
    for i in range(0, 120, 2):  # pairs of near fingerprints; all 120 share 12 positional bytes, other pairs are far apart
        one = np.concatenate([base[:12], rng.integers(0, 256, 52, np.uint8)])
        two = one.copy()
        two[12:] ^= (1 << rng.integers(0, 8, 52)).astype(np.uint8)  # no byte but the shared ones agrees
        rows += [(i, bytearray(one)), (i + 1, bytearray(two))]
    links = simhash.similar_links(spark.createDataFrame(rows, "rep long, fp binary"), 0.8, hot=8).collect()
    assert {tuple(sorted(x)) for x in links} == {(i, i + 1) for i in range(0, 120, 2)}


def test_keys_met_by_chance_are_left_out(spark):
    """Fingerprints of which each byte is one of 16 (four bits apart at least), so that keys often agree by chance; of such lists of two few stay, of
    near pairs' lists all do."""
    rng = np.random.default_rng(11)
    code = np.array([x for x in range(256) if all(bin(x & m).count("1") % 2 == 0 for m in (0x0F, 0x33, 0x55, 0xFF))], np.uint8)
    assert len(code) == 16
    far = code[rng.integers(0, 16, (400, 64))]
    near = far[:60].copy()
    flips = rng.integers(0, 512, (60, 50))  # at most 50 bits
    for i, x in enumerate(flips):
        near[i] ^= np.packbits(np.isin(np.arange(512), x))
    fps = np.concatenate([far, near])
    entries = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(fps)], "rep long, fp binary")
    lists = {}
    for k, (a, b) in enumerate(simhash.KEY_SHAPES):
        for first in range(64):
            for i, x in enumerate(fps):
                lists.setdefault((k, first, x[first], x[(first + a) % 64], x[(first + b) % 64]), []).append(i)
    two = [x for x in lists.values() if len(x) == 2]
    planted = [x for x in two if x[1] == x[0] + 400]
    got = {}
    for x in simhash.met_keys(entries, 0.8).collect():
        got.setdefault(x.key, []).append(x.rep)
    kept = [sorted(x) for x in got.values() if len(x) == 2]
    chance = [x for x in kept if x[1] != x[0] + 400]
    assert len(planted) > 1500 and sum(x[1] == x[0] + 400 for x in kept) == len(planted)
    assert len(two) - len(planted) > 5000 and len(chance) < 0.1 * (len(two) - len(planted))
    assert sorted(map(sorted, (x for x in got.values() if len(x) > 2))) == sorted(x for x in lists.values() if len(x) > 2)


def test_similar_dedup_is_by_exact_jaccard(spark):
    """Documents of 4 to 112 shingles, each with a partner just at 0.8 or just under it. Pairs under 0.8 are never linked,
    pairs of few shingles at 0.8 always, others but for what the fingerprints' index misses there (some 2%)."""
    docs, want, few = [], set(), set()
    for k in range(120):
        shared, own = (4, 0) if k % 8 == 7 else (80 + k % 9, 10)  # 4 of 5, or 80/100 and above
        pair = [[f"w{k}x{j}" for j in range(shared + 4)] for _ in range(2)]
        for side, words in enumerate(pair):
            if k % 2 == 1 and own == 10:
                words += [f"s{k}y{side}z{j}" for j in range(shared // 8)]  # shared / (shared + 2 * (shared // 8)) >= 0.8
            elif own == 10:
                words += [f"s{k}y{side}z{j}" for j in range(shared // 8 + 2)]
            elif side:
                words += ["more"]
            docs.append((2 * k + side, " ".join(words)))
        sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in pair]
        few |= {2 * k + 1} if own == 0 else set()
        want |= {2 * k} if len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8 else {2 * k, 2 * k + 1}
    kept = {x.doc_id for x in simhash.similar_dedup(frame(spark, docs), hot=8).collect()}
    assert kept >= want and not kept & few and 120 < len(want) < 200 and len(kept - want) <= 4


def test_repeated_rows_in_pipeline_stages(spark):
    """A doc_id that stands at several texts, repeated rows and null ids: rows are dropped and changed, not ids."""
    a, b, c = (" ".join(f"{x}{j}" for j in range(30)) for x in "abc")
    docs = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, "null one"), (None, "null one"), (None, "null two")]
    kept = sorted((x.doc_id or 0, x.text) for x in simhash.similar_dedup(frame(spark, docs)).collect())
    assert kept == [(0, "null one"), (0, "null two"), (1, a), (2, b), (3, c)]
    docs = [(1, a + " " + b), (2, "x " + a + " y"), (2, "z " + b + " w")]
    left = sorted((x.doc_id, x.text) for x in substring.substring_filter(frame(spark, docs)).collect())
    assert left == [(1, a + " " + b), (2, "x y"), (2, "z w")]


def test_exact_links_of_a_long_group(spark):
    """A chain of sets, each like the next only, in a group of many blocks; one set is like none."""
    rows = [(0, i, bytearray(np.arange(10 * i, 10 * i + 100, dtype=np.uint64).tobytes()), 100) for i in range(40)]
    rows.append((0, 40, bytearray(np.arange(9000, 9100, dtype=np.uint64).tobytes()), 100))
    sets = spark.createDataFrame(rows, "grp long, node long, set binary, n long")
    from orewright.llm.common import components

    assert {(x.node, x.component) for x in components(simhash.exact_links(sets, 0.8, hot=4)).collect()} == {(i, 0) for i in range(40)}


def test_components_in_shares_and_at_once(spark, monkeypatch):
    """Chains, stars and single links, contracted in one share or in many and then in rounds."""
    from orewright.llm import common

    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(9)] + [(300, 301), (301, 300), (400, 400)]
    df = spark.createDataFrame(links, "u long, v long").repartition(3)
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(9)} | {300: 300, 301: 300}
    for size in (500, 7):
        monkeypatch.setattr(common, "CONTRACTED", size)
        got = common.components(df).collect()
        assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert common.components(df.limit(0)).count() == 0


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    own = bpe.Bpe(path)
    pieces = ["aaaa", " ", "  ", "\n", "it's", "<|endoftext|>", "é", "日本", "12345", "՘", "ab" * 9, "!!!", "x" * 40, "\xa0", "’", "\x85", "ᲀ"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(300)] + [t or "" for _, t in DOCUMENTS]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    docs = frame(spark)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()
    assert all(x.decoded == (x.text or "") for x in back) and docs.columns == ["doc_id", "text", "chunk", "n", "label"]


def test_lines(spark):
    got = {x.doc_id: (x.n_lines, x.n_removed) for x in lines.line_report(frame(spark)).collect()}
    base = DOCUMENTS[-5][0]
    assert [got[base + k] for k in range(4)] == [(5, 0), (5, 3), (3, 3), (5, 4)] and got[0] == (1, 0)
    left = {x.doc_id: x.text for x in lines.line_dedup(frame(spark)).collect()}
    assert left[base + 1] == "x\ny" and base + 2 not in left and left[0] is None


def test_lines_of_repeated_ids_and_rows(spark):
    """Rows are told apart by id and text: a second text under an id keeps its own lines, repeated rows lose the same."""
    docs = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (2, "own 1\nown 2\nown 3\nown 4"), (3, "p\na\nb\nc"), (3, "p\na\nb\nc"), (None, "a\nb\nc\nz")]
    left = sorted((x.doc_id or 0, x.text) for x in lines.line_dedup(frame(spark, docs)).collect())
    assert left == [(0, docs[5][1]), (1, docs[0][1]), (2, docs[2][1]), (2, "x"), (3, "p"), (3, "p")]
    assert lines.line_report(frame(spark, [])).count() == 0


def test_packing(spark):
    lengths, counts = np.array([3, 4, 9, 10, 30]), np.array([5, 1, 2, 2, 1])
    best = min(sum(c * (min(e for e in (*cut, 30) if e >= n) - n) for n, c in zip(lengths, counts)) for cut in [(a, b) for a in lengths for b in lengths])
    ends = packing.boundaries(lengths, counts, 3)
    assert sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts)) == best
    rows = packing.pack(frame(spark), max_len=50, buckets=4, budget=200).collect()
    total, kept = {}, {}
    for x in sorted(rows, key=lambda x: x.piece):
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
        kept.setdefault(x.doc_id, []).append(x.text)
        assert x.n_tokens + x.padding == x.pad_to <= 50 and x.slot < 200 // x.pad_to and len(x.text.split(" ")) == x.n_tokens
    assert total == {i: len(brute.words(t)) for i, t in DOCUMENTS if brute.words(t)}
    assert {i: " ".join(t).encode() for i, t in kept.items()} == {i: b" ".join(brute.words(t)) for i, t in DOCUMENTS if brute.words(t)}
    assert packing.pack(frame(spark, [])).count() == 0 and packing.pack(frame(spark, [(None, None), (1, " ")])).count() == 0


def test_packing_rows_against_every_choice(spark):
    """Total padding is the least of all choices of bucket ends, and batches are full but for the last of each bucket."""
    from itertools import combinations

    docs = [(i % 25, "w " * (1 + (i * i) % 13)) for i in range(60)] + [(None, "a b")]
    rows = packing.pack(frame(spark, docs), max_len=9, buckets=3, budget=20).collect()
    lengths = [n for _, t in docs for m in [len(t.split())] for n in [9] * (m // 9) + [m % 9] if n]
    assert sorted(x.n_tokens for x in rows) == sorted(lengths)
    kinds = sorted(set(lengths))
    best = min(sum(min(e for e in ends if e >= n) - n for n in lengths) for k in (1, 2, 3) for ends in combinations(kinds, k) if ends[-1] == kinds[-1])
    assert sum(x.padding for x in rows) == best
    for bucket in {x.bucket for x in rows}:
        own = [x for x in rows if x.bucket == bucket]
        room = 20 // own[0].pad_to
        assert sorted((x.batch, x.slot) for x in own) == [divmod(i, room) for i in range(len(own))]


def test_packing_of_token_ids(spark):
    """The ids of BPE go through packing whole: pieces in order decode to the text."""
    from pyspark.sql import functions as F

    path = vocabulary_path()
    rows = packing.pack(bpe.bpe_encode(frame(spark), path), F.col("ids"), max_len=64, budget=256).collect()
    own, back = bpe.load(path), {}
    for x in sorted(rows, key=lambda x: x.piece):
        back.setdefault(x.doc_id, []).extend(x.tokens)
    assert {i: own.decode(t) for i, t in back.items()} == {i: t for i, t in DOCUMENTS if t}


def test_quality_keeps_clean_and_drops_junk(spark):
    def clean(k):
        return "\n".join(" ".join(r.choice(VOCABULARY[:5]) + str(r.randint(0, 400)) for _ in range(9)) + "." for _ in range(6))

    docs = [(i, clean(i)) for i in range(60)] + [(100 + i, clean(i).upper().replace(" ", "!%%% ")) for i in range(20)]
    kept = {x.doc_id for x in quality.quality_filter(frame(spark, docs)).collect()}
    assert kept == set(range(60))
    posterior, accuracy = quality.estimate(np.array([[1, 1, 0], [0, 0, 1], [1, 2, 1]]), np.array([50.0, 10.0, 40.0]))
    assert posterior[0] > 0.5 > posterior[1] and accuracy[0] > 0.8


def test_quality_drops_junk_of_one_bad_vote(spark):
    def clean(k):
        return "\n".join(" ".join(r.choice(VOCABULARY[:5]) + str(r.randint(0, 400)) for _ in range(9)) + "." for _ in range(6))

    docs = [(i, clean(i)) for i in range(60)] + [(100 + i, clean(i).replace(" ", "%%% ")) for i in range(20)]
    kept = {x.doc_id for x in quality.quality_filter(frame(spark, docs)).collect()}
    assert kept == set(range(60))
    for n in (20.0, 600.0, 3000.0):
        posterior, _ = quality.estimate(np.array([[1] * 7, [0] + [1] * 6]), np.array([6000.0, n]))
        assert posterior[0] > 0.9 and posterior[1] < 0.3


def test_quality_against_plain_version(spark):
    """The label model row by row, features one by one, a scorer that no small step betters, and scores of all rows."""
    clean = lambda k: "\n".join(" ".join(r.choice(VOCABULARY[:5]) + str(r.randint(0, 400)) for _ in range(9)) + "." for _ in range(6))
    texts = [clean(i) for i in range(40)] + [clean(i).upper().replace(" ", "!%%% ") for i in range(10)] + [None, "", "x", "%%%" * 50, "ab " * 9000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (0, texts[45])]
    stats = [quality.statistics(t) for _, t in docs]
    votes = quality.votes(np.array(stats))
    want = brute.label_model(votes.tolist())
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, _ = quality.estimate(patterns.astype(np.int64), n.astype(float))
    assert posterior[back.ravel()] == pytest.approx(want, abs=1e-6)

    w, bias, _ = quality.fit(frame(spark, docs), buckets=256)
    x = np.array([brute.features(t, s, 256) for (_, t), s in zip(docs, stats)])
    one = {(i, t): k for k, (i, t) in enumerate(docs)}  # rows alike are one in training
    xs, ys = x[list(one.values())], np.array(want)[list(one.values())]
    off = 1 / (1 + np.exp(-(xs @ w + bias))) - ys
    assert abs(off.mean()) < 0.02 and np.abs(xs.T @ off / len(xs) + 1e-4 * w).max() < 0.02
    got = quality.quality_scores(frame(spark, docs), buckets=256).collect()
    score = {docs[k]: 1 / (1 + np.exp(-(x[k] @ w + bias))) for k in range(len(docs))}
    assert len(got) == len(docs) and all(g.score == pytest.approx(score[(g.doc.doc_id, g.doc.text)], abs=1e-4) and g.keep == (g.score >= 0.5) for g in got)
    assert quality.quality_scores(frame(spark, [])).count() == 0
    again, bias2, _ = quality.fit(frame(spark, docs, parts=5), sample=20, buckets=256)
    first, bias1, _ = quality.fit(frame(spark, docs, parts=2), sample=20, buckets=256)
    assert (again == first).all() and bias1 == bias2  # the sample does not depend on how rows are dealt


PAGES = [
    ("<body><nav><a>m</a></nav><div class=ad>buy</div><article><h1>T &amp; t</h1><p>a  b\n c<br>d<p>e <b>f</b></article><footer>z</footer>", "T & t\na b c d\ne f"),
    ("<div id=content><h1>Title here</h1><p>Many words of text stand here in a row.</p><form><input>x</form></div><div id=comments><p>me too</p></div>", "Title here\nMany words of text stand here in a row."),
    (None, ""), ("", ""), ("<p>open <b>ends", "open ends"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    assert [x.text for x in html.extract(pages).orderBy("page_id").collect()] == [t for _, t in PAGES]
    assert html.region([-1, 2, -1, 3, -9, 4]) == (1, 4) and html.region([-1.0]) == (0, 0)


def test_html_region_against_every_interval():
    """The scan finds the greatest sum of all intervals; at ties the first, then the longest."""
    for _ in range(400):
        scores = [r.randint(-4, 4) / 2 for _ in range(r.randint(0, 12))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        best = max(sums.values(), default=0)
        begin, end = html.region(scores)
        assert sum(scores[begin:end]) == max(best, 0) and (best > 0 or begin == end)


def brute_text(page, weights):
    """The text by trying every interval of words and tags."""
    items = html.read(page).items
    scores = html.scores_of(items, weights)
    best = max(((sum(scores[a:b]), -a, b) for a in range(len(items)) for b in range(a + 1, len(items) + 1)), default=(0, 0, 0))
    out = [[]]
    for x in items[-best[1] : best[2]] if best[0] > 0 else []:
        if isinstance(x, html.Run):
            out[-1].append("" if x.never else x.text)
        elif x[2]:
            out.append([])
        else:
            out[-1].append(" " if x[1] == "br" else "")
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def test_html_odd_input_against_brute_force(spark):
    """Broken and long pages, names on layout boxes, repeated rows, clashing columns, an empty table."""
    words = "word " * 3000
    odd = [
        ("<div class='box has-sidebar'><main><article><h1>T</h1><p>" + words + "</p></article></main><div class=sidebar>side</div></div>", "T\n" + words.strip()),
        ("<div><article><p>a card</p></article></div><h1>Real</h1><p>" + "real " * 60 + "</p><footer>f</footer>", "a card\nReal\n" + ("real " * 60).strip()),
        ("<article><p>one two three</p><script>" + "x " * 900 + "</script><aside>n n</aside><p>four <a>five</a></p><ul><li><a>six</a></ul></article><p>Rights reserved by all of us here</p>", "one two three\nfour five\nsix"),
        ("<article><p>a &lt;b&gt; &amp;amp; c", "a <b> &amp; c"), ("<", "<"), ("<!-- <p>x</p>", ""),
    ]
    rows = [(i % 3, "u", h, "x", 1) for i, (h, _) in enumerate(odd + PAGES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((x.page_id, x.text) for x in html.extract(pages).collect())
    assert got == sorted([(i % 3, t) for i, (_, t) in enumerate(odd + PAGES)] * 2)
    assert html.extract(pages.limit(0)).count() == 0
    weights = html.learn(*html.tally([html.read(x) for x in html.LAYOUTS], own=False))
    for page in [h for h, _ in odd[1:] + PAGES] + list(html.LAYOUTS):
        assert html.main_text(page, weights) == brute_text(page, weights)


LONG = "me too " * 60
ARTICLE = "<h1>T</h1><p>" + "one two three four five six seven eight " * 5 + "</p>"
TEXT = "T\n" + ("one two three four five six seven eight " * 5).strip()
POST = "<li><span class='author'>Ann</span> <time>1 May</time> <p>" + "so true " * 40 + "</p></li>"


@pytest.mark.parametrize(
    "page, text",
    [
        # Reader comments longer than the article: by name, inside and after it, and by authors and dates alone.
        (f"<body><article>{ARTICLE}<div id='comments'>{LONG}</div></article></body>", TEXT),
        (f"<body><article>{ARTICLE}</article><section class='comment-list'>{LONG}</section></body>", TEXT),
        (f"<body><div class='post-content'>{ARTICLE}</div><ol class='x9'>{POST * 5}</ol></body>", TEXT),
        (f"<body><main>{ARTICLE}<article class='comment'>{LONG}</article><article class='comment'>{LONG}</article></main></body>", TEXT),
        # Names that hold such a word but mean something else.
        *[(f"<body><article>{ARTICLE}<section {name}><h2>More</h2><p>results of it all</p></section></article></body>", TEXT + "\nMore\nresults of it all") for name in ("class='discussion'", "class='side-by-side'", "class='notice-board'", "id='search-results'", "id='credit-rating'", "class='commentary'")],
        # Names of other parts, inside the article too, at any size; names on what holds the article.
        *[(f"<body><article>{ARTICLE}<div {name}>{LONG}</div><p>the end</p></article></body>", TEXT + "\nthe end") for name in ("class='ad'", "class='cookie-notice'", "id='relatedPosts'", "class='share-buttons'", "class='x newsletter-signup'")],
        (f"<body><div class='banner-section'><article>{ARTICLE}</article></div><footer>f f f</footer></body>", TEXT),
        (f"<body><article>{ARTICLE}<p>where <math><mi>x</mi>=<mn>2</mn></math> and <label>more</label> words</p></article></body>", TEXT + "\nwhere x=2 and more words"),
        (f"<body><header><p>{LONG}</p></header><main><header><h1>Head</h1></header><article><header><h2>Sub</h2></header>{ARTICLE}</article></main></body>", "Head\nSub\n" + TEXT),
        (f"<body><article>{ARTICLE}<aside>{LONG * 9}</aside><p>the end of it</p></article></body>", TEXT + "\nthe end of it"),
    ],
)
def test_html_contract(spark, page, text):
    weights = html.learn(*html.tally([html.read(x) for x in html.LAYOUTS], own=False))
    assert html.main_text(page, weights) == text


def test_ppm_is_a_distribution_and_base_is_exact(spark):
    texts = ["abab abba", "abba baba", "ab"]
    all_ = ppm.strings_of(ppm.stream_of(texts, 3), 3)
    u, n = np.unique(all_, return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs.reshape(-1), (u & np.uint64(65535)).astype(int), n)
    context = all_[4] >> np.uint64(8)
    every = np.union1d(u[(u >> np.uint64(8) & np.uint64(65535)) == (context & np.uint64(65535))], context << np.uint64(8) | np.arange(256, dtype=np.uint64))
    counts = np.array([dict(zip(u.tolist(), n.tolist())).get(x, 0) for x in every.tolist()])
    lp = ppm.log_probabilities(every, counts, pairs, 3)
    assert abs((10 ** lp[(every >> np.uint64(8)) == context]).sum() - 1) < 1e-9
    got = {x.doc_id: x for x in ppm.ppm_scores(frame(spark), chunk_bytes=30000).collect()}
    want = brute.base(DOCUMENTS)
    for i, (held, tokens, known, total, base) in want.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, tokens, known, total)
        assert x.base_score == pytest.approx(base) and x.score < 0
    assert ppm.ppm_scores(frame(spark, [])).count() == 0


def test_ppm_score_against_plain_contexts(spark):
    """Repeated texts, nulls, long texts, and training texts in several chunks."""
    docs = DOCUMENTS[:-1] + [(900 + i, "abra cadabra ab" + "ra" * i) for i in range(9)] + [(950, "w " * 300)]
    for order in (2, 4):
        want = brute.ppm(docs, order)
        for hot_pair in (ppm.HOT_PAIR, 60, -1):  # no, some and all pairs of bytes split by the byte before them
            got = {x.doc_id: x.score for x in ppm.ppm_scores(frame(spark, docs), depth=order, chunk_bytes=2000, hot_pair=hot_pair).collect()}
            assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-5, abs=1e-5) for i in want)


def test_rows_of_one_id_spread_over_chunks(spark):
    """Rows without an id, or of one id, are in several chunks and give what they give in one."""
    docs = [(None, f"{PASSAGE} {i}") for i in range(12)] + [(7, f"{PASSAGE} {i}") for i in range(12)] + [(1, "lead " + PASSAGE)]
    one, many = ({(x.doc_id, x.n_removed, x.kept_sha256) for x in substring.substring_dedup(frame(spark, docs), chunk_bytes=n).collect()} for n in (1 << 20, 900))
    assert one == many and {x[1] for x in one if x[0] == 7} == {60}
    one, many = ({(x.doc_id, round(x.score, 3), x.n_known) for x in ppm.ppm_scores(frame(spark, docs), depth=3, chunk_bytes=n).collect()} for n in (1 << 20, 900))
    assert one == many


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist(), i % 2, "x") for i in range(80)]
    rows += [(100, rows[0][1], 0, "x"), (101, [v * 2 for v in rows[0][1]], 0, "x"), (102, None, 0, "x"), (103, [0.0] * 4, 0, "x"), (104, [1.0, None, 0.0, 0.0], 0, "x"), (105, [float("nan"), 1.0, 0.0, 0.0], 1, "x"), (106, rows[0][1], None, "x"), (107, [1.0, 2.0], 0, "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")


def test_embeddings(spark):
    rows, df = vectors(spark)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in emb.near_duplicates(df, threshold=0.9, block=8, anchors=4).collect()}
    assert got == brute.cosine_groups(rows, 0.9)


def test_top_k(spark):
    rows, df = vectors(spark)
    from pyspark.sql import functions as F

    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, k=3, annulus=7, pivots=5).collect())
    assert got == brute.top_k(rows, 20, 3)


@pytest.mark.parametrize("n", [1, 4, 11, 12])
def test_top_k_of_few_candidates(spark, n):
    """Queries with fewer candidates than k, as many, and one more."""
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 3), 1.0 - i], 0, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 2 == 0, annulus=3, pivots=2).collect())
    assert got == brute.top_k(rows, 2, 10) and len(got) == (n + 1) // 2 * min(10, n - 1)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_top_k_of_wide_vectors(spark):
    """Finite components of any size take part; ranks are exact beyond 64 bits, and equal vectors tie."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (i % 13 * 3)).astype(np.float32).tolist(), 0, "x") for i in range(60)]
    rows += [(100 + i, rows[51][1], 0, "x") for i in range(5)] + [(200, [3e38, -3e38, 3e38], 0, "x"), (201, [65536.0, 0.0, 1.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 4 == 0, k=5, annulus=7, pivots=5, query_block=3).collect())
    near = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert got == [(q, rank, i, near(s)) for q, rank, i, s in brute.top_k(rows, 4, 5)]


def test_pipeline_stages_keep_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in DOCUMENTS], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(x.n_chars == len(x.text or "") for x in out.collect())
