import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shopledger.llm import slices, substrings
from shopledger.llm.queries import op4_substring_dedup


def brute(rows, window=13):
    """(key, text) rows -> list of (key, words, removed, kept), by comparing all windows."""
    order = lambda k: (k is None, k or 0)
    split = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in split:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            first[run] = min(first.get(run, (True, 1 << 62)), order(k))
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(k):
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect()), key=str)


def passages(rng, n):
    """Documents made of shared and own passages of various lengths."""
    shared = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(5, 40))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        out.append((i, "\n".join(parts)))
    return out


def test_many_slices_and_groups(docs, monkeypatch):
    monkeypatch.setattr(substrings, "parts_for", lambda df, size, part=0: 6)
    rows = passages(random.Random(5), 120)
    assert found(substrings.without_repeats(docs(rows))) == brute(rows)


@pytest.mark.parametrize("trees", [1, 40])
def test_colliding_short_codes_and_many_trees(docs, monkeypatch, trees):
    """Short codes of few bits: most runs look repeated at first, and the trees tell."""
    monkeypatch.setattr(substrings, "parts_for", lambda df, size, part=0: 6)
    monkeypatch.setattr(substrings, "SPARE_BITS", -8)
    monkeypatch.setattr(substrings, "TREE_SUFFIXES", 3 if trees > 1 else 10**6)
    rows = passages(random.Random(7), 120)
    assert found(substrings.without_repeats(docs(rows))) == brute(rows)


def test_runs_of_one_code_are_told_apart():
    texts = [b" ".join(b"a%d" % (i % 40) for i in range(100)), b"x " * 30, b"x " * 5 + b"y " * 30]
    own = substrings.Suffixes(pa.array([t.decode() for t in texts]), 13)
    plain = [tuple(b" ".join(texts).split()[s : s + 13]) for s in own.starts.tolist()]
    own.codes[:] = own.codes & np.uint64(3)  # nearly all collide
    first, node = own.nodes()
    kinds = {}
    for run, n in zip(plain, node.tolist(), strict=True):
        assert kinds.setdefault(n, run) == run and plain[first[n]] == run
    assert len(kinds) == len(set(plain)) == len(first)


def test_a_third_of_the_rows_under_one_key_and_under_none(docs, monkeypatch):
    monkeypatch.setattr(substrings, "parts_for", lambda df, size, part=0: 9)
    rng = random.Random(8)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, t) for i, (_, t) in enumerate(passages(rng, 240))]
    table = docs(rows)
    cut = slices.key_slices(table, "doc_id", "text", 9)
    sizes = [r["count"] for r in table.withColumn("s", cut.slice(table.doc_id, table.text)).groupBy("s").count().collect()]
    assert max(sizes) < 60 and len(sizes) >= 6
    assert found(substrings.without_repeats(table)) == brute(rows)


def test_slices_hold_about_equal_bytes(docs):
    rows = [(i, "word " * (2000 if i < 20 else 20)) for i in range(400)]
    table = docs(rows)
    cut = slices.key_slices(table, "doc_id", "text", 10)
    placed = table.withColumn("s", cut.slice(table.doc_id, table.text)).selectExpr("s", "doc_id", "length(text) n").collect()
    sizes = Counter()
    for r in placed:
        sizes[r["s"]] += r["n"]
    assert len(sizes) >= 8 and max(sizes.values()) <= 3 * sum(sizes.values()) / 10
    order = sorted((r["doc_id"], cut.order[r["s"]]) for r in placed)
    assert [o for _, o in order] == sorted(o for _, o in order)


def test_keys_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        substrings.without_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_a_line_that_a_third_of_the_documents_share(docs, monkeypatch):
    """Its runs reach a group and a tree once a slice, however many documents have them."""
    monkeypatch.setattr(substrings, "parts_for", lambda df, size, part=0: 8)
    line, rng = " ".join(f"shared{i}" for i in range(40)), random.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) + (f" {line}" if i % 3 == 0 else "")) for i in range(600)]
    out = found(substrings.without_repeats(docs(rows)))
    assert out == brute(rows) and sum(r[2] for r in out) == 40 * 199


def test_words_are_parted_by_six_characters():
    texts = ["  a \t\x0b b\r\n", None, "", "x\x1cy\x85z\u2003w \x0cq"]
    flat, counts = substrings.tokens(pa.array(texts))
    assert flat.to_pylist() == [w.decode() for t in texts for w in (t or "").encode().split()] and counts.tolist() == [2, 0, 0, 2]


def test_short_windows(docs):
    rows = passages(random.Random(6), 40)
    assert found(substrings.without_repeats(docs(rows), window=3)) == brute(rows, 3)


def test_odd_rows_and_clashing_columns(odd):
    frame = odd.withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    assert found(substrings.without_repeats(frame)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_rows_of_one_key_and_of_no_key(docs):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(2, text), (2, text), (7, text + " tail"), (None, text), (None, text)]
    assert found(substrings.without_repeats(docs(rows))) == brute(rows)
    rows = [(None, text), (None, text + " x")]
    assert found(substrings.without_repeats(docs(rows))) == brute(rows)


def test_cleaned_keeps_the_columns_and_untouched_texts(docs):
    text = " ".join(f"w{i}" for i in range(20))
    out = {r["doc_id"]: r["text"] for r in substrings.cleaned(docs([(1, "a\n" + text), (2, text + " end"), (3, None)])).collect()}
    assert out == {1: "a\n" + text, 2: "end", 3: None}
    assert substrings.cleaned(docs([(1, "x")])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(docs):
    assert substrings.without_repeats(docs([])).count() == 0


def test_code_lists_survive_packing():
    rng = np.random.default_rng(1)
    for codes in (np.zeros(1, np.uint64), np.unique(rng.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2)), np.array([2**64 - 1], np.uint64), np.zeros(0, np.uint64), np.array([3, 4, 2**64 - 1], np.uint64), np.arange(99, dtype=np.uint64)):
        assert (slices.unpacked_codes(slices.packed_codes(codes)) == codes).all()
    for bits in (9, 33, 50, 64):
        codes = np.unique(rng.integers(0, (1 << bits) - 1, 5000, np.uint64, endpoint=True))
        assert (slices.unpacked_codes(slices.packed_codes(codes)) == codes).all()
        assert len(slices.packed_codes(codes)) * 8 <= len(codes) * (bits - np.log2(len(codes)) + 2) + 200
    counts = np.array([0, 1, 255, 256, 10**9])
    assert (slices.unpacked_counts(slices.packed_counts(counts)) == counts).all()
    assert slices.group_bounds(np.array([0, 2**63, 2**64 - 1], np.uint64), 2).tolist() == [0, 1, 3]


def test_query(spark, small):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = op4_substring_dedup(spark, small).collect()
    want = sorted((k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute(texts))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == want
