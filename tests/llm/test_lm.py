import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopledger.llm import lm
from shopledger.llm.queries import op8_lm_scores


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def base(rows, train):
    """(key, text) rows -> sorted (key, tokens, known, training tokens, base score)."""
    count = Counter(w for k, t in rows if k in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for k, t in rows:
        own = tokens(t)
        out.append((k, len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), 6)))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=str)


def test_odd_rows_and_clashing_columns(odd):
    rows = odd.withColumnRenamed("lang", "score").withColumnRenamed("source", "cell")
    out = lm.scored(rows, F.col("doc_id") % 2 == 0).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(out) == base(texts, {k for k, _ in texts if k is not None and k % 2 == 0})
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)


def test_nothing_to_learn_from(docs):
    out = lm.scored(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert found(out) == base([(1, "a b"), (2, None)], set())
    assert lm.scored(docs([]), F.lit(True)).count() == 0


def words_of(rng, n):
    return " ".join(rng.choice(["x", "y", "z"]) + str(rng.randint(0, 9)) for _ in range(n))


def test_counts_over_many_chunks_and_orders(docs, monkeypatch):
    monkeypatch.setattr(lm, "parts_for", lambda df, size, part=0: 5)
    rng = random.Random(8)
    rows = [(i, words_of(rng, rng.randint(0, 30))) for i in range(150)]
    scores = {}
    for order in (1, 2, 3):
        out = lm.scored(docs(rows), F.col("doc_id") % 5 != 0, order=order).collect()
        assert found(out) == base(rows, {k for k, _ in rows if k % 5})
        scores[order] = {r["doc_id"]: r["score"] for r in out}
    assert all(math.isfinite(s) for by in scores.values() for s in by.values())


def test_probabilities_sum_to_one():
    """For a context, the mix over all known tokens and one unseen token is a distribution."""
    texts = [b"a b a c", b"a b", b"c"]
    grams = lm.Grams(texts, 2)
    table = grams.distinct()
    one, two = (dict(zip(c.tolist(), n.tolist(), strict=True)) for c, n in table)
    total, seen = sum(one.values()), len(one)
    weights = [0.1, 0.3, 0.6]
    context = lm.Grams([b"a"], 2).codes[0][0]
    mass = weights[0] / (seen + 1)  # the unseen token
    for token in (b"a", b"b", b"c"):
        pair = lm.Grams([b"a " + token], 2).codes
        mass += weights[0] / (seen + 1) + weights[1] * one[int(pair[0][1])] / total + weights[2] * two.get(int(pair[1][1]), 0) / one[int(context)]
    end = lm.Grams([b"a"], 2).codes
    mass += weights[0] / (seen + 1) + weights[1] * one[int(end[0][1])] / total + weights[2] * two.get(int(end[1][1]), 0) / one[int(context)]
    assert abs(mass - 1) < 1e-9


def test_em_finds_the_order_that_explains():
    # Bucket 3: the bigram estimate is much better than the others; bucket 1: it is always zero.
    cells = {"3,5,-1": 900, "3,5,z": 20, "1,5,z": 500}
    weights = lm.learn(cells, 1e5, 1000, 2)
    assert weights["3"][2] > 0.8 and weights["1"][2] < 0.1
    assert all(abs(sum(w) - 1) < 1e-9 for w in weights.values())
    assert lm.learn({}, 0, 0, 2) == {}


def plain_scores(rows, train, fold, order):
    """The model's log10 probability of each text, from counts of word tuples."""

    def grams(text):
        words = [b" begin"] * (order - 1) + tokens(text)
        return [[tuple(words[i - n + 1 : i + 1]) for n in range(1, order + 1)] for i in range(order - 1, len(words))]

    every, main = Counter(), Counter()
    for k, t in rows:
        for own in grams(t) if k in train else []:
            every.update(own)
            if k not in fold:
                main.update(own)

    def told(count, own, total):
        """Context count of the longest order and the estimates."""
        # Before the first word stands nothing, as often as there are texts: each has one end.
        before = [total] + [count[g[:-1]] if g[-2] != b" begin" else count[(b" ",)] for g in own[1:]]
        return before[-1] if order > 1 else 0, [count[g] / max(1.0, b) for g, b in zip(own, before, strict=True)]

    total, main_total = (sum(n for g, n in c.items() if len(g) == 1) for c in (every, main))
    distinct, main_distinct = (sum(len(g) == 1 for g in c) for c in (every, main))
    cells = Counter()
    for k, t in rows:
        if k in train and k in fold:
            for own in grams(t):
                context, p = told(main, own, main_total)
                logs = [main[own[0]], *p[1:]]
                cell = [int(math.ceil(math.log2(context + 1)))] + ["z" if x <= 0 else int(round(math.log(x) / lm.CELL)) for x in logs]
                cells[",".join(map(str, cell))] += 1
    weights = lm._weight_table(lm.learn(dict(cells), main_total, main_distinct, order), order)
    out = {}
    for k, t in rows:
        score = 0.0
        for own in grams(t):
            context, p = told(every, own, total)
            w = weights[int(math.ceil(math.log2(context + 1)))]
            score += math.log10(w[0] / (distinct + 1) + sum(a * b for a, b in zip(w[1:], p, strict=True)))
        out[k] = score
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_a_plain_computation(spark, docs, order):
    rng = random.Random(order)
    rows = [(i, words_of(rng, rng.randint(0, 25))) for i in range(120)] + [(500, None), (501, "x1 " * 40)]
    train = {k for k, _ in rows if k % 5}
    marks = spark.createDataFrame([(k,) for k, _ in rows], "k bigint").select("k", (F.pmod(F.xxhash64("k"), F.lit(lm.FOLDS)) == 0).alias("fold"))
    fold = {r["k"] for r in marks.collect() if r["fold"]}
    out = {r["doc_id"]: r["score"] for r in lm.scored(docs(rows), F.col("doc_id") % 5 != 0, order=order).collect()}
    want = plain_scores(rows, train, fold, order)
    assert all(abs(out[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in want)


def test_rows_without_a_key_are_dealt_over_chunks(docs, monkeypatch):
    monkeypatch.setattr(lm, "parts_for", lambda df, size, part=0: 5)
    rows = [(None, words_of(random.Random(i), 20)) for i in range(60)] + [(i, words_of(random.Random(i), 9)) for i in range(30)]
    out = lm.scored(docs(rows), F.col("doc_id").isNotNull()).collect()
    assert found(out) == base(rows, {k for k, _ in rows if k is not None})


def test_query(spark, small):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    train = {k for k, _ in texts if zlib.crc32(str(k).encode()) % 7 != 2}
    rows = op8_lm_scores(spark, small).collect()
    assert found(rows) == base(texts, train) and all(r["held_out"] == (r["doc_id"] not in train) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # unseen text is better explained


def test_codes_are_tallied_in_their_own_array():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 5000):
        codes = rng.integers(0, 900, size).astype(np.uint64)
        want = np.unique(codes, return_counts=True)
        got = lm._tallied(codes)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
        assert np.array_equal(codes, np.sort(codes))  # sorted where it lies, not in a copy
    grams = lm.Grams([b"a b a", b"b a b a"], 3)
    before = [c.copy() for c in grams.codes]
    grams.distinct()
    assert all(np.array_equal(a, b) for a, b in zip(grams.codes, before, strict=True))
