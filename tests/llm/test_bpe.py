import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopledger.llm import bpe
from shopledger.llm.queries import op1_bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as file:
        return bpe.TrieBpe(file.read())


def ids_of(model, texts):
    ids, starts = model.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_ids_equal_the_library_on_random_texts(model, library):
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(1, 0x250), 0x300, 0x3A3, 0x3C2, 0x2028, 0x3000, 0x1F600, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0xFB01, 0xE000]]
    parts = ["the", "running", "I'm", "'re", "<|endoftext|>", "<|endoftext", "12345", "aaaaaaaaaa", "ÀÉ", " ", "  "]
    texts = ["".join(rng.choice([rng.choice(pool), rng.choice("abcdehint "), rng.choice(parts)]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert ids_of(model, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_in_small_steps_and_of_long_pieces(model, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP_PIECES", 2)
    texts = ["several words that come again", "again several", "", "a" * 200 + " " + "b" * 49, "x" * 48]
    for _ in range(2):
        assert ids_of(model, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pairs_are_looked_up_again_after_the_table_was_full(model, library):
    model._pairs = bpe._Table(4)
    texts = ["enough different words to fill a table of sixteen places several times over"]
    assert ids_of(model, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_rows_and_clashing_columns(odd, vocabulary, library):
    rows = bpe.with_tokens(odd.withColumn("ids", F.lit("old")).withColumn("extra", F.col("doc_id")), vocabulary).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["extra"] == r["doc_id"]


def test_decoding_leaves_out_unknown_ids(spark, vocabulary):
    rows = spark.createDataFrame([(1, [320, 99_999_999, None, 321]), (2, None), (3, [])], "k int, ids array<int>")
    out = {r["k"]: r["t"] for r in rows.select("k", bpe.decoded(vocabulary, F.col("ids")).alias("t")).collect()}
    assert out[1].count(" ") == 1 and out[2] == "" and out[3] == ""


def test_empty_table(docs, vocabulary):
    assert bpe.with_tokens(docs([]), vocabulary).count() == 0


def test_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op1_bpe_round_trip(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
