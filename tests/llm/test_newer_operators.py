"""Importance resampling, secret scans and centroid clustering against plain versions, over nulls, empty and long texts,
ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from orewright.llm import centroids, resample, secrets

r = random.Random(11)
WORDS = ["the", "Thing", "of", "été", "re9", "Ünd", "x", "日本", "AND", "zz"]


def texts():
    out = [None, "", " .,;\n", "one", "The the THE", "a-b_c'd e"]
    out += [" ".join(r.choice(WORDS) + r.choice(["", ".", "-x"]) for _ in range(r.randint(1, 60))) for _ in range(40)]
    return out + ["long word " * 20000]


DOCS = [*enumerate(texts()), (7, "repeated id here " * 9), (None, "no id here " * 9), (None, "no id here " * 9), (None, None), (9, texts()[9]), (9, "x " * 30), (9, "x " * 30)]
SCHEMA = "doc_id long, text string, n int, rank string, secrets int, bucket int, place int, kind string"


def frame(spark, docs=DOCS, parts=3):
    return spark.createDataFrame([(i, t, 1, "r", 2, 3, 4, "k") for i, t in docs], SCHEMA).repartition(parts)


def plain_resample(docs, target, buckets, lo, hi, least, percent):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, side in ((s, docs), (t, target)):
        for _, x in side:
            for b in features(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(x)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in rows if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = {id(x): k + 1 for k, x in enumerate(fit[: percent * len(fit) // 100])}
    return [(i, n, w, sc, drawn.get(id(x))) for x in rows for i, _, n, w, sc in [x]]


@pytest.mark.parametrize("lo,hi", [(1, 1), (1, 3), (2, 2)])
def test_importance_ranks(spark, lo, hi):
    target = [(i, t) for i, t in enumerate(["the thing of", None, "", "été 日本 zz the thing " * 5])]
    got = resample.importance_ranks(frame(spark), frame(spark, target), buckets=50, lo=lo, hi=hi, percent=40).collect()
    want = plain_resample(DOCS, target, 50, lo, hi, 20, 40)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    ranks = lambda rows: sorted((x[4], x[3]) for x in rows if x[4] is not None)
    have = [(x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in got]
    # Rows that tie in score and doc_id may change places: compare the rest exactly, and ranks with scores.
    assert sorted((x[:4] for x in have), key=key) == sorted((x[:4] for x in want), key=key) and ranks(have) == ranks(want)
    assert len({x[4] for x in have if x[4]}) == len(ranks(want)) > 5


def test_importance_of_nothing(spark):
    assert resample.importance_ranks(frame(spark, []), frame(spark)).count() == 0
    alone = resample.importance_ranks(frame(spark), frame(spark, []), percent=100).collect()
    assert sorted(x.rank for x in alone if x.rank) == list(range(1, sum(x.n_words >= 20 for x in alone) + 1))
    target = frame(spark, [(1, "the thing of " * 50)])
    chosen, ranks = resample.resample(frame(spark), target, percent=10), resample.importance_ranks(frame(spark), target, percent=10)
    assert chosen.columns == frame(spark).columns
    key = lambda rows: sorted((x.doc_id is None, x.doc_id or 0) for x in rows)
    drawn = key(ranks.where("rank is not null").collect())
    assert set(key(chosen.collect())) == set(drawn) and len(drawn) >= 2


def token(prefix: str, good: bool = True) -> str:
    body = "".join(r.choice(secrets.ALPHABET.decode()) for _ in range(30))
    crc, digits = zlib.crc32(body.encode()) + (0 if good else 1), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = secrets.ALPHABET.decode()[d] + digits
    return prefix + body + digits


def plain_spans(text):
    """Every rule by a search of the whole text."""
    text = text or ""
    low = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(f"""({low})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    for k, kind, pattern in ((3, "code", "gh[pousr]_[A-Za-z0-9]+"), (4, "registry", "npm_[A-Za-z0-9]+")):
        for m in re.finditer(pattern, text):
            crc, digits = zlib.crc32(m.group()[4:34].encode()), ""
            for _ in range(6):
                crc, d = divmod(crc, 62)
                digits = secrets.ALPHABET.decode()[d] + digits
            if len(m.group()) == 40 and m.group()[34:] == digits:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def secret_texts():
    pieces = ["password", "PassWd", "secret", "token", "API_KEY", "apikey", "apiKey", "'", '"', " ", "  ", ":", "=", "abcdefgh", "x.y/z+1=", "0123456789abcdef", "AKIA", "ABCD1234EFGH", "é", "日", "ſecret", "toKen", "ghp_", "npm_", "\n", "f" * 16, "0" * 40, "token=abc=", "secret:secret:abcdefgh1"]
    out = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(600)]
    out += [f"é {token(p)} {token(p, False)} {token(p)}x" for p in ("ghp_", "ghs_", "npm_", "GHP_")]
    out += ["f" * n for n in (15, 16, 31, 32, 33, 47, 63, 64, 100)] + ["g" + "a" * n + "g" for n in (31, 32, 40)] + ["a" * 20, "b" * 20]
    return out + [None, "", "x" * 300_000 + " token = '0123456789abcdef' " + "é" * 1000 + "0" * 50]


def test_secrets_against_whole_searches(spark, monkeypatch):
    docs = list(enumerate(secret_texts())) + [(None, "token: abcdefgh1"), (3, "token: abcdefgh1"), (3, "token: abcdefgh1")]
    want = sorted((-1 if i is None else i, plain_spans(t)) for i, t in docs)
    for piece in (secrets.PIECE, 700):  # texts scanned together and nearly one by one
        monkeypatch.setattr(secrets, "PIECE", piece)
        found = secrets.find_secrets(frame(spark, docs))
        assert found.columns == [c for c in frame(spark).columns if c != "secrets"] + ["secrets"]
        got = sorted((-1 if x.doc_id is None else x.doc_id, [(s.kind, s.start, s.end) for s in x.secrets]) for x in found.collect())
        assert got == want
    kinds = {k for _, spans in want for k, *_ in spans}
    assert kinds == {"assign", "access", "hex", "code", "registry"}


def test_secret_report_and_redaction(spark):
    docs = [(i, t) for i, t in enumerate(secret_texts())]
    got = {x.doc_id: x for x in secrets.secret_report(frame(spark, docs)).collect()}
    for i, t in docs:
        spans = plain_spans(t)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in ("assign", "access", "hex"))
        n = [sum(k == kind for k, *_ in spans) for kind in ("assign", "access", "hex")]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == n and got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    clean = secrets.redact(frame(spark, docs))
    assert clean.columns == frame(spark).columns
    for x in clean.collect():
        t = dict(docs)[x.doc_id]
        if t is None:
            assert x.text is None
            continue
        marks = np.zeros(len(t) + 1, bool)
        for _, a, b in plain_spans(t):
            marks[a:b] = True
        kept = "".join(c for c, m in zip(t, marks) if not m)
        assert x.text.replace("[secret]", "") == kept
    assert secrets.secret_report(frame(spark, [])).count() == 0 and secrets.redact(frame(spark, [])).count() == 0


def plain_lloyd(rows, k, rounds, dim):
    v = [(i, [math.floor(x * 1024) if abs(x) < 1e15 else int(x) * 1024 for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[0] or 0, x[1])
    c = [x for _, x in sorted(v, key=key)[:k]]
    near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in v]
        for j in range(len(c)):
            part = [x for (_, x), o in zip(v, own) if o == j]
            if part:
                c[j] = [sum(z) // len(part) for z in zip(*part)]
    found = [(i, *near(x)) for i, x in v]
    clip = lambda d: min(d, 2**63 - 1)
    total = sum(clip(d) for _, d, _ in found)
    return sorted(((i is None, i or 0), o, clip(d), clip(sum(clip(e) for _, e, p in found if p == o)), clip(total), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, d, o in found)


def clusters(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, block string").repartition(3)
    got = centroids.centroid_clusters(df, k=k, rounds=rounds, dim=dim).collect()
    return sorted(((x.vec_id is None, x.vec_id or 0), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in got)


def vectors(n, dim, seed, scale=1.0, places=1):
    g = np.random.default_rng(seed)
    return [(i, (g.normal(size=dim) * scale + 3 * g.integers(0, 3, dim)).round(places).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,dim,block", [(5, 3, 4096), (16, 4, 7), (1, 2, 4096)])
def test_centroids(spark, monkeypatch, k, dim, block):
    """Whole tables of few distinct components (many ties), repeated rows and ids, and what takes no part."""
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = vectors(150, dim, k, places=0) + vectors(40, dim, k + 1)
    rows += [(0, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (None, rows[3][1]), (900, None), (901, [1.0] * (dim + 1)), (902, [None] + [1.0] * (dim - 1)), (903, [math.nan] * dim), (904, [math.inf] * dim), (905, [])]
    assert clusters(spark, rows, k, 4, dim) == plain_lloyd(rows, k, 4, dim)


def test_centroids_of_great_components(spark):
    """Components beyond 64 bits, beside small ones."""
    rows = vectors(40, 3, 1) + [(100 + i, [10.0**e, -(10.0**e), 1.0]) for i, e in enumerate((5, 9, 18, 38, 200, 300) * 2)]
    assert clusters(spark, rows, 6, 3, 3) == plain_lloyd(rows, 6, 3, 3)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_centroids_of_few_vectors(spark, n):
    rows = vectors(n, 2, 5)
    assert clusters(spark, rows, 4, 2, 2) == plain_lloyd(rows, 4, 2, 2)


def test_ball_finds_the_nearest_two():
    """With loose and tight bounds alike, over rounds of moving centroids, the assignment is that of all distances."""
    g = np.random.default_rng(9)
    x = g.integers(-9, 9, (400, 3))
    own, upper, lower, before = np.zeros(400, np.int64), np.full(400, math.inf), np.zeros(400), None
    c = g.integers(-9, 9, (20, 3))
    for _ in range(6):
        ball = centroids.Ball(c.tolist())
        ball.moved(before, own, upper, lower)
        ball.assign(x, own, upper, lower)
        d = centroids.squared(x, c)
        assert (own == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(np.sort(d, 1)[:, 1]) + 1e-6).all()
        before, c = ball, c + g.integers(-1, 2, c.shape)
