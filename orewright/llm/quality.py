"""A quality classifier without labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts
of vote patterns (all documents; at most 3 ** labellers patterns, whatever the input) estimates how each labeller
votes on good and on bad documents, and so the posterior of each pattern. A linear scorer over hashed features learns
these posteriors from a sample of at most `SAMPLE` documents, chosen by a hash of doc_id and text, and scores every document.

Results for odd input: null and empty texts get no votes beyond abstentions and the score of no features; rows with
the same text get the same score; rows that repeat a doc_id are scored each; other columns stay as they are; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import widened

SAMPLE = 2048
BUCKETS = 4096
THRESHOLD = 0.5
GOOD, BAD, ABSTAIN = 1, 0, 2

_SYMBOLS = [ord(c) for c in "#$%&*@^~<>{}[]|\\/=+_"]
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TRIGRAM = np.uint32(0x9E3779B1)


def statistics(text: str | None) -> np.ndarray:
    """Shares that the labellers and the scorer look at: symbols, capitals, exclamation marks, repeated words, repeated lines,
    lines that end as sentences, and short words; NaN where a text has too little to tell."""
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    upper, letters = count[65:91].sum(), count[65:91].sum() + count[97:123].sum()
    out = np.full(7, np.nan)
    if words:
        out[0] = count[_SYMBOLS].sum() / len(raw)
        out[2] = count[33] / len(raw)
        out[5] = sum(x.rstrip()[-1] in b".!?:;\"'" for x in lines) / len(lines)
    if letters >= 20:
        out[1] = upper / letters
    if len(words) >= 30:
        out[3] = 1 - len(set(words)) / len(words)
        spelled = [len(x) for x in words if x.strip(_PUNCTUATION)]
        out[6] = sum(n <= 4 for n in spelled) / max(1, len(spelled))
    if len(lines) >= 4:
        out[4] = 1 - len(set(lines)) / len(lines)
    return out


#: Each labeller: a statistic, good up to the first bound, bad from the second, no vote between them.
LABELLERS = (
    ("symbols", 0, 0.01, 0.03),
    ("capitals", 1, 0.12, 0.30),
    ("exclamations", 2, 0.002, 0.01),
    ("repeated words", 3, 0.45, 0.65),
    ("repeated lines", 4, 0.10, 0.30),
    ("open line ends", 5, 0.10, 0.40),
    ("odd word lengths", 6, 0.15, 0.25),
)


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes of all labellers; rows of statistics in."""
    out = np.full((len(stats), len(LABELLERS)), ABSTAIN, np.int8)
    for j, (name, k, low, high) in enumerate(LABELLERS):
        x = stats[:, k]
        x = 1 - x if name == "open line ends" else abs(x - 0.5) if name == "odd word lengths" else x
        out[x <= low, j] = GOOD
        out[x >= high, j] = BAD
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Dawid and Skene's model by EM: the posterior of `good` for each vote pattern, and each labeller's accuracy.

    Patterns without a bad vote anchor the good class; a labeller that calls most documents bad is not asked there. Others
    start from their votes, each by how rare it is for its labeller, and the rates of the classes are smoothed towards those
    of the anchors and of the others. So labellers that are good on everything do not outvote a bad vote of one that tells.
    """
    cast = np.stack([patterns == BAD, patterns == GOOD], axis=2).astype(float)  # no vote tells nothing
    seen = np.einsum("p,pjv->jv", counts, cast) + 1
    overall = seen / seen.sum(1, keepdims=True)
    told = np.einsum("pjv,jv->pv", cast, -np.log(overall))
    asked = seen[:, 0] <= seen[:, 1]
    anchor = ((patterns == GOOD) & asked).any(1) & ~((patterns == BAD) & asked).any(1)
    posterior = np.where(anchor, 1.0, 1 / (1 + np.exp(told[:, 0] - told[:, 1])))
    near = np.einsum("yp,pjv->yjv", np.stack([~anchor, anchor]) * counts, cast) + overall
    near /= near.sum(2, keepdims=True)
    for _ in range(rounds):
        share = np.stack([1 - posterior, posterior]) * counts
        prior = (share.sum(1) + 1) / (counts.sum() + 2)
        rate = np.einsum("yp,pjv->yjv", share, cast) + near
        rate /= rate.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("pjv,yjv->yp", cast, np.log(rate))
        posterior = np.where(anchor, 1.0, 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))
    return posterior, prior[0] * rate[0, :, BAD] + prior[1] * rate[1, :, GOOD]


def features(text: str | None, stats: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Byte trigrams and the statistics' tenths, hashed into buckets: root frequencies, then marks of weight one."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    out = np.zeros(buckets, np.float32)
    if len(raw) >= 3:
        grams = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * _TRIGRAM >> shift
        out += np.sqrt(np.bincount(grams, minlength=buckets) / len(grams))
    for k, x in enumerate(stats):
        mark = np.array([0x01000000 + k * 16 + (11 if np.isnan(x) else int(min(max(x, 0), 1) * 10))], np.uint32)
        out[(mark * _TRIGRAM >> shift)[0]] += 1
    return out


def train(x: np.ndarray, target: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, by accelerated gradient steps."""
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return w, bias
    step = np.float32(4 / (np.square(x).sum(1).max() + 1))
    target, across = target.astype(np.float32), np.ascontiguousarray(x.T)
    past, past_bias = w, bias
    for k in range(rounds):
        push = np.float32(k / (k + 3))
        at, at_bias = w + push * (w - past), bias + float(push) * (bias - past_bias)
        off = 1 / (1 + np.exp(-np.clip(x @ at + np.float32(at_bias), -80, 80))) - target
        past, past_bias = w, bias
        w = at - step * (across @ off / np.float32(len(x)) + np.float32(penalty) * at)
        bias = at_bias - float(step * off.mean())
    return w, float(bias)


def fit(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[np.ndarray, float, dict[str, float]]:
    """The scorer's weights and bias, and the estimated accuracy of each labeller."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = votes(np.array([statistics(x.as_py()) for x in batch["text"]]).reshape(-1, 7))
            code = made.astype(np.int64) @ 3 ** np.arange(len(LABELLERS))
            yield pa.record_batch({"pattern": pa.array(code, pa.int64())})

    rows = docs.select("text").mapInArrow(vote, "pattern long").groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r.pattern for r in rows], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posterior, accuracy = estimate(patterns, np.array([r["count"] for r in rows], float)) if rows else (np.zeros(0), np.full(len(LABELLERS), 0.5))
    target = dict(zip(codes.tolist(), posterior.tolist()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            stats = np.array([statistics(t) for t in texts]).reshape(-1, 7)
            code = votes(stats).astype(np.int64) @ 3 ** np.arange(len(LABELLERS))
            x = [features(t, s, buckets).tobytes() for t, s in zip(texts, stats)]
            yield pa.record_batch({"h": batch["h"], "x": pa.array(x, pa.binary()), "pattern": pa.array(code, pa.int64())})

    # At most `sample` different (doc_id, text), the least by hash; rows alike in both are one.
    keyed = docs.select(F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"), "text")
    some = keyed.select("h").distinct().orderBy("h").limit(sample)
    chosen = keyed.join(F.broadcast(some), "h").dropDuplicates(["h"])
    learned = chosen.mapInArrow(learn, "h long, x binary, pattern long").toArrow().sort_by("h").combine_chunks()
    blob = learned["x"].combine_chunks().buffers()[2] if len(learned) else b""
    x = np.frombuffer(blob, np.float32, len(learned) * buckets).reshape(-1, buckets)
    w, bias = train(x, np.array([target[p] for p in learned["pattern"].to_pylist()]))
    return w, bias, {name: float(a) for (name, *_), a in zip(LABELLERS, accuracy)}


def quality_scores(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns inside `doc`, with their score (the probability of good) and whether they are kept."""
    w, bias, _ = fit(docs, sample, buckets)
    inner = docs.select(F.struct(*docs.columns).alias("doc"))
    schema = widened(inner.schema, score="double", keep="boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch["doc"].field("text"))
            made = [features(t, statistics(t), buckets) @ w + bias for t in texts]
            p = 1 / (1 + np.exp(-np.clip(np.array(made, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(p, pa.float64()), pa.array(p >= threshold)], names=["doc", "score", "keep"])

    return inner.mapInArrow(score, schema)


def quality_filter(docs: DataFrame, **how) -> DataFrame:
    """The documents that the classifier keeps, all columns."""
    return quality_scores(docs, **how).where("keep").select("doc.*")
