import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shopledger.llm import packing
from shopledger.llm.queries import op10_best_fit_packing


def best_fit(lengths, capacity):
    """Best fit, longest first, document by document: number of bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] -= n
    return len(rooms)


def check_places(rows, capacity):
    """Each sequence is filled without gaps from 0 and not beyond its capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_best_fit_over_documents(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))] + [capacity // 3] * rng.randint(0, 100)
    slots = packing.plan_slots(Counter(lengths), capacity)
    placed = []
    for length, low, high, sequence, base, per_bin in slots:
        for r in range(low, high):
            placed.append({"length": length, "sequence_id": sequence + (r - low) // per_bin, "offset": base + (r - low) % per_bin * length})
    assert Counter(p["length"] for p in placed) == Counter(lengths)
    assert check_places(placed, capacity) == best_fit(lengths, capacity)


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.plan_slots({9: 1}, 8)


def test_one_length_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 10)
    rows = spark.createDataFrame([(i, 5 if i % 3 else i % 9 + 1) for i in range(500)], "id int, length int")
    out = packing.packed(rows, 16, ["id", "length"]).collect()
    assert sorted((r["id"], r["length"]) for r in out) == sorted(map(tuple, rows.collect()))
    assert check_places(out, 16) == best_fit([r["length"] for r in out], 16)


def test_odd_rows(odd, vocabulary):
    rows = packing.pack_documents(odd.withColumnRenamed("source", "length").withColumnRenamed("lang", "sequence_id"), vocabulary, 64).collect()
    check_places(rows, 64)
    empty = [r for r in rows if r["doc_id"] in (0, 1, 2)]
    assert all((r["piece"], r["length"]) == (0, 1) for r in empty) and len(empty) == 3
    assert sum(r["doc_id"] == 4 and r["piece"] == 0 for r in rows) == 2
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_empty_table(docs, vocabulary):
    assert packing.pack_documents(docs([]), vocabulary).count() == 0


def test_sequences_list_their_pieces(docs, vocabulary):
    placed = packing.pack_documents(docs([(1, "one two"), (2, "three")]), vocabulary, 64)
    row = packing.sequence_ids(placed).first()
    assert row["tokens"] == 5 and [p["offset"] for p in row["pieces"]] == [0, 3]


def test_query(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = {}, 0
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for at in range(0, len(ids), 2048):
            own = np.array(ids[at : at + 2048], "<u4")
            want[r["doc_id"], at // 2048] = (at, len(own), zlib.crc32(own.tobytes()))
    rows = op10_best_fit_packing(spark, small).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert check_places(rows, 2048) == best_fit([n for _, n, _ in want.values()], 2048)
