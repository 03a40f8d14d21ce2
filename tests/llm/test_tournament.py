import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer as Library

from shopledger.llm import tournament
from shopledger.llm.queries import op12_tournament_packing
from shopledger.llm.tokenizers import ByteTokens, Tokenizer

from .test_packing import check_places


def plain_first_fit(lengths, capacity):
    bins = []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        found = next((b for b in bins if sum(lengths[p] for p in b) + lengths[piece] <= capacity), None)
        if found is None:
            bins.append([piece])
        else:
            found.append(piece)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_tree_equals_plain_first_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 250))]
    assert tournament.first_fit_decreasing(lengths, capacity) == plain_first_fit(lengths, capacity)


@pytest.mark.parametrize("seed", range(8))
def test_group_has_no_padding_and_few_cuts(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64 if seed % 2 else 1 + seed) for _ in range(rng.randint(1, 400))]
    parts = tournament.packed_group(lengths, 64)
    got = {}
    for piece, first, length, _, _ in parts:
        got.setdefault(piece, []).append((first, length))
    assert {p: sum(n for _, n in x) for p, x in got.items()} == dict(enumerate(lengths))
    for own in got.values():
        at = 0
        for first, length in sorted(own):
            assert first == at and length > 0
            at += length
    rows = [{"sequence_id": s, "offset": o, "length": n} for _, _, n, s, o in parts]
    check_places(rows, 64)
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values())
    gaps = sum(sum(lengths[p] for p in b) < 64 for b in tournament.first_fit_decreasing(lengths, 64))
    assert len(parts) - len(lengths) <= gaps + 6


@pytest.fixture(scope="module")
def tokens(spark):
    return Tokenizer(spark, ByteTokens, P.path("byte_bpe_50k.json"), P.PATTERN)


def check(rows, texts, capacity):
    """Every id of every text in one piece; texts by key, each key once."""
    library = Library.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for key, own in by.items():
        ids, at = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    check_places(rows, capacity)
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert all(n == capacity or n & (n - 1) == 0 for n in fill.values())
    return len(fill)


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_rows(docs, odd, tokens, monkeypatch, broadcast):
    monkeypatch.setattr(tournament, "GROUP_PIECES", 7)
    monkeypatch.setattr(tournament, "BROADCAST_CUTS", 10**6 if broadcast else -1)
    clash = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumnRenamed("source", "length").withColumnRenamed("lang", "__ids")
    check(tournament.pack_documents(clash, tokens, 64).collect(), {r["doc_id"]: r["text"] for r in clash.collect()}, 64)


def test_repeated_and_missing_keys(docs, tokens):
    rows = tournament.pack_documents(docs([(1, "one"), (1, "one"), (None, "one"), (None, None)]), tokens, 64).collect()
    assert sum(r["length"] for r in rows) == 7
    assert {(r["doc_id"], r["doc_tokens"]) for r in rows} == {(1, 2), (None, 2), (None, 1)}


def test_text_keys_and_empty_table(spark, docs, tokens):
    assert tournament.pack_documents(spark.createDataFrame([("k", "one")], "doc_id string, text string"), tokens).first()["doc_id"] == "k"
    assert tournament.pack_documents(docs([]), tokens).count() == 0


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op12_tournament_packing(spark, small).collect()
    total = sum(r["length"] for r in rows)
    assert check(rows, texts, 2048) <= total // 2048 + 11
