"""Empty tables, ids that repeat or are missing, very long texts and clashing columns, for what test_operators leaves out."""

import hashlib
import os
import struct
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from orewright.llm import bpe, packing, simhash  # noqa: E402
from orewright.llm import embeddings as emb  # noqa: E402
from orewright.llm.common import shared_folder  # noqa: E402
from orewright.llm.queries import QUERIES, vocabulary_path  # noqa: E402

SCHEMA = "doc_id long, text string, row string, spread int, fp long, n int, component long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "r", 1, 2, 3, 4) for i, t in docs], SCHEMA).repartition(3)


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_bpe_of_repeated_ids_and_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    docs = [(1, "one two"), (1, "one two"), (1, "three"), (None, "four"), (2, None), (3, "Prefix prefixes " * 40000), (4, "q" * 3000)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        made = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want.append((str(i), len(ids), made, hashlib.sha256(decoded).hexdigest()))
    got = QUERIES["op1_bpe"](spark, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == sorted(want)
    assert bpe.bpe_decode(bpe.bpe_encode(frame(spark, []), vocabulary_path()), vocabulary_path()).count() == 0


def test_simhash_of_repeated_and_missing_ids(spark):
    """Texts of one id, or of none, are linked each for itself: their ids connect nothing."""
    a, b, c = words("a"), words("b"), words("c")
    docs = [(5, a), (5, b), (2, a), (None, c), (None, b), (None, words("d")), (7, c), (9, words("e")), (9, words("e"))]
    got = simhash.simhash_groups(frame(spark, docs)).collect()
    plain = brute.simhash(list(enumerate(t for _, t in docs)))
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[plain[k][1]] = min(i, least.get(plain[k][1], i))
    want = [(str(i), plain[k][0], str(least.get(plain[k][1]))) for k, (i, _) in enumerate(docs)]
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == sorted(want)
    assert {str(x.component_id) for x in got} == {"2", "5", "7", "9", "None"}
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_embeddings_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, n string")
    assert emb.near_duplicates(df, threshold=0.9).count() == 0


def test_packing_deals_rows_without_ids_by_their_contents(spark, monkeypatch):
    """Rows of no id, or of one, lie in several shares, and batches stay whole."""
    monkeypatch.setattr(packing, "SHARE_ROWS", 10)
    docs = [(None, words(f"n{i}", 5)) for i in range(40)] + [(1, words(f"o{i}", 5)) for i in range(40)]
    shares = {(x.doc_id, x.spread % 8) for x in packing.piece_lengths(frame(spark, docs)).collect()}
    assert len(shares) > 8
    rows = packing.pack(frame(spark, docs), max_len=9, buckets=3, budget=20).collect()
    assert sorted(x.text for x in rows) == sorted(t for _, t in docs)
    places = sorted((x.batch, x.slot) for x in rows)
    assert places == [(k // 4, k % 4) for k in range(80)] and {x.pad_to for x in rows} == {5}


@pytest.mark.parametrize("docs", [[], [(1, None), (None, ""), (2, " \n")], [(i, words(f"w{i % 3}x", 60)) for i in range(6)]])
def test_pipeline_in_one_chain(spark, tmp_path, docs):
    """The whole chain over an empty table, over texts without words, and over copies; columns clash, one table stays behind."""
    pipeline = pytest.importorskip("corpus_pipeline")
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    tables = lambda: {x for x in os.listdir(shared_folder(spark).replace("file:", "")) if x.startswith("table-")}
    before = tables()
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert len(tables() - before) == 1
    assert len({x.text for x in rows}) == len(rows) and {x.text for x in rows} <= {t for _, t in docs}
