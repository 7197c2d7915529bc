"""Plain, slow versions of the operators' definitions."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(text):
    return WORD.findall((text or "").encode())


def substring(docs, size=13):
    """docs: (doc_id, text). Returns doc_id -> (n_words, n_removed, kept_sha256)."""
    first, split = {}, {}
    for i, text in docs:
        split[i] = w = words(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def simhash(docs, shingle=3, max_bits=3):
    """doc_id -> (fingerprint, component_id)."""
    import xxhash

    fps = {}
    for i, text in docs:
        w = words((text or "").encode().lower().decode())
        parts = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= max_bits and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def base(docs):
    """doc_id -> held_out, n_tokens, n_known, train_tokens, base_score."""
    import zlib
    from collections import Counter
    from math import log10

    tokens = {i: [*words((t or "").encode().lower().decode()), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(t), sum(count[w] > 0 for w in t), n, sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens.items()}


def cosine_groups(rows, threshold):
    import numpy as np

    def unit(v):
        if not v or any(x is None or x != x for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.sqrt((v * v).sum())

    u = {i: (unit(v), label) for i, v, label, _ in rows}
    root, n = {i: i for i in u}, dict.fromkeys(u, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in u:
        for b in u:
            (x, la), (y, lb) = u[a], u[b]
            if a < b and x is not None and y is not None and la is not None and la == lb and len(x) == len(y) and x @ y >= threshold:
                n[a] += 1
                n[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in u}


def top_k(rows, every, k):
    import math

    import numpy as np

    whole = {}
    for i, v, *_ in rows:
        if v and all(x is not None and x == x for x in v):
            whole[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], c)), i) for i, c in whole.items() if i != q and len(c) == len(whole[q]))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def ppm(docs, order):
    """doc_id -> log10 probability: every context of every training text counted plainly, symbol by symbol."""
    import zlib
    from collections import Counter, defaultdict
    from math import log10

    text = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in docs}
    seen = defaultdict(Counter)
    for i, t in text.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            padded = b"\n" * order + t
            for at in range(order, len(padded)):
                for k in range(order + 1):
                    seen[padded[at - k : at]][padded[at]] += 1

    def probability(context, symbol):
        p, gone = 1.0, set()
        for k in range(order, -1, -1):
            here = seen[context[len(context) - k :]]
            rest = {s: n for s, n in here.items() if s not in gone}
            if symbol in rest:
                return p * (2 * rest[symbol] - 1) / (2 * sum(rest.values()))
            if rest:
                p *= len(rest) / (2 * sum(rest.values()))
            gone = set(here) or gone
        return p / (256 - len(seen[b""]))

    out = {}
    for i, t in text.items():
        padded = b"\n" * order + t
        out[i] = sum(log10(probability(padded[at - order : at], padded[at])) for at in range(order, len(padded)))
    return out


def label_model(rows, rounds=100):
    """Posteriors of `good` for rows of votes (1 good, 0 bad, 2 none), one row and one labeller at a time."""
    from math import exp, log

    m = len(rows[0])
    seen = [[1 + sum(v[j] == k for v in rows) for k in (0, 1)] for j in range(m)]
    overall = [[a / (a + b), b / (a + b)] for a, b in seen]
    asked = [a <= b for a, b in seen]
    anchor = [any(v[j] == 1 and asked[j] for j in range(m)) and not any(v[j] == 0 and asked[j] for j in range(m)) for v in rows]
    told = lambda v, k: sum(-log(overall[j][k]) for j in range(m) if v[j] == k)
    good = [1.0 if a else 1 / (1 + exp(told(v, 0) - told(v, 1))) for v, a in zip(rows, anchor)]

    def rates(weight, near):
        out = []
        for j in range(m):
            n = [near[j][k] + sum(w for w, v in zip(weight, rows) if v[j] == k) for k in (0, 1)]
            out.append([x / sum(n) for x in n])
        return out

    near = [rates([float(a == y) for a in anchor], overall) for y in (False, True)]
    for _ in range(rounds):
        weights = [[1 - g for g in good], good]
        prior = [(sum(w) + 1) / (len(rows) + 2) for w in weights]
        rate = [rates(weights[y], near[y]) for y in (0, 1)]
        log_of = lambda v, y: log(prior[y]) + sum(log(rate[y][j][v[j]]) for j in range(m) if v[j] != 2)  # noqa: B023,E731
        good = [1.0 if a else 1 / (1 + exp(max(-700, min(700, log_of(v, 0) - log_of(v, 1))))) for v, a in zip(rows, anchor)]
    return good


def features(text, stats, buckets):
    """Root frequencies of hashed byte trigrams and a mark for each statistic, one at a time."""
    from collections import Counter
    from math import isnan, sqrt

    shift, raw = 32 - (buckets.bit_length() - 1), (text or "").encode()
    at = lambda x: (x * 0x9E3779B1 & 0xFFFFFFFF) >> shift
    grams = Counter(at(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) for i in range(len(raw) - 2))
    out = [0.0] * buckets
    for k, n in grams.items():
        out[k] += sqrt(n / (len(raw) - 2))
    for k, x in enumerate(stats):
        out[at(0x01000000 + k * 16 + (11 if isnan(x) else int(min(max(x, 0), 1) * 10)))] += 1
    return out
