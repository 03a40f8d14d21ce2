import math
import random
import re
from collections import Counter

import pytest

from shopledger.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plainly(docs, items, k):
    """All scores of all pairs: (item, rank, key, score)."""
    bags = [(key, terms(text)) for key, text in docs]
    bags = [(key, len(t), Counter(t)) for key, t in bags if t]
    n_docs, length = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, n, count in bags:
            m = 100 - 25 + 25 * n * n_docs // length
            score = 0
            for t in terms(text):
                if t in count:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * count[t] // (1000 * count[t] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key, score))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, key, score) for i, (_, _, key, score) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 n", "2 rank", "3 score", "4 __item").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in ranked.search(table, asked, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ODD = [None, "", "  .,; ", "ÀÉ naïve café", "word " * 20_000, "a_b-c 12 12.5 x y", "\x00\x7fend", "中文 中文"]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("small", [True, False])
def test_against_all_scores(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(ranked, "SHARD_POSTINGS", 40)
        monkeypatch.setattr(ranked, "FIRST_DEPTH", 1)
        monkeypatch.setattr(ranked, "BLOCK_BYTES", 200)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(250)]
    texts += texts[:3] * 20 + [texts[5]] * 60  # ties
    docs = [*enumerate(texts + ODD), (None, texts[5]), (3, texts[3])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(12)]
    items += [(12, None), (13, "..."), (14, "naïve 中文 word CAFé"), (None, "w1 w1 w2"), (15, texts[5])]
    assert found(spark, docs, items, 20) == plainly(docs, items, 20)


def test_equal_items_give_one_list(spark):
    docs = [(1, "one two"), (2, "two"), (3, "three")]
    assert found(spark, docs, [(1, "two"), (1, "two")], 5) == plainly(docs, [(1, "two")], 5)


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "one"), ("a", "one"), (None, "one"), ("c", "two")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "one")], "item_id string, text string")
    rows = ranked.search(docs, items).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [("i", 1, "a"), ("i", 2, "b"), ("i", 3, None)]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "one")], "doc_id bigint, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(some, items.where("item_id < 0")).count() == 0


def test_reading_stops_before_the_end():
    """A document far ahead of the rest is final before long lists are read out."""
    import numpy as np

    sizes = np.full(5000, 100)
    term = np.concatenate([np.zeros(5000, np.int64), [1]])
    many = np.array([1] * 4999 + [2])
    order = np.argsort(np.concatenate([np.arange(5000), [4999]]), kind="stable")
    tf = np.concatenate([np.ones(4999, np.int64), [50], [9]])[order]
    shard = ranked.Shard(sizes, many, term[order], tf, 5000, 500_000, 2)
    reads = []
    shard._docs = lambda low, high: (reads.append(int((high - low).max())), ranked.Shard._taken(shard.doc, low, high))[1]
    docs, score = shard.best((np.array([0, 1]), np.array([1, 1])), np.array([5, 7000]), 1, 0)
    assert docs.tolist() == [4999] and len(score) == 1 and max(reads) < 5000
