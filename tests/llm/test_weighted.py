import hashlib
from collections import Counter

from pyspark.sql import functions as F

from shopledger.llm import slices, weighted
from shopledger.llm.queries import op3_weighted_fingerprints


def expected(rows):
    """(key, text) rows -> key, length, edited text, true similarity to the edited and to the next text."""

    def alike(a, b):
        x, y = Counter(w for w in a.replace("\n", " ").split(" ") if w), Counter(w for w in b.replace("\n", " ").split(" ") if w)
        return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0

    rows = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    out = []
    for i, (key, text) in enumerate(rows):
        follows = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + follows[:third]
        out.append((key, len(text), edited, alike(text, edited), alike(text, follows)))
    return out


def check(frame, rows):
    found = sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in frame), key=str)
    assert found == sorted(((k, n, e) for k, n, e, _, _ in expected(rows)), key=str)


def test_odd_rows_and_clashing_columns(odd):
    rows = weighted.fingerprints(odd.withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "_slice")).collect()
    check(rows, [(r["doc_id"], r["text"] or "") for r in odd.collect()])
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["fingerprint"] == by[5]["fingerprint"]
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == "0" * 256
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_one_document_and_none(docs):
    (row,) = weighted.fingerprints(docs([(3, "abc def")])).collect()
    assert row["edited"] == "abc deab"[:5] + "ab" and row["near_next"] == 1.0
    assert weighted.fingerprints(docs([])).count() == 0


def test_neighbours_across_many_slices(docs, monkeypatch):
    monkeypatch.setattr(weighted, "parts_for", lambda df, size, part=0: 7)
    rows = [(i * 3 % 101, f"text of number {i}") for i in range(101)]
    check(weighted.fingerprints(docs(rows)).collect(), rows)


def test_a_third_of_the_rows_under_one_key_and_under_none(docs, monkeypatch):
    """Such rows are dealt over slices; every row still has exactly one next row, in the order of keys."""
    monkeypatch.setattr(weighted, "parts_for", lambda df, size, part=0: 9)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} " * 5) for i in range(150)]
    table = docs(rows)
    placed = [r for r in weighted.neighbours(table).collect() if r["_real"]]
    follows = {r["_text"]: r["_next"] for r in placed}
    key = {t: k for k, t in rows}
    at, seen = placed[0]["_text"], []
    while at not in seen:
        seen.append(at)
        at = follows[at]
    assert len(seen) == len(rows) and len({r["_slice"] for r in placed}) >= 6
    keys = [key[t] for t in seen]
    start = next(i for i in range(len(keys)) if keys[i] is None and keys[i - 1] is not None)
    keys = keys[start:] + keys[:start]
    assert keys == sorted(keys, key=lambda k: (k is not None, -(k or 0)))
    assert len(weighted.fingerprints(table).collect()) == len(rows)


def test_share_of_equal_samples_is_the_similarity(spark, small):
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {k: (a, b) for k, _, _, a, b in expected(texts)}
    rows = op3_weighted_fingerprints(spark, small).collect()
    edited = {k: hashlib.sha256(e.encode()).hexdigest() for k, _, e, _, _ in expected(texts)}
    assert all(r["edited_sha256"] == edited[r["doc_id"]] for r in rows) and len(rows) == len(texts)
    off = [(r["near_edited"] - want[r["doc_id"]][0]) for r in rows]
    # Standard deviation of a share of 32 samples is 0.09 at most; the mean is unbiased.
    assert abs(sum(off) / len(off)) < 0.03 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.12


def test_weights_count(docs):
    rows = docs([(2, "a " * 30 + "b"), (1, "a " * 10 + "b " * 10)])
    near = {r["doc_id"]: r["near_next"] for r in weighted.fingerprints(rows, samples=64).collect()}
    assert abs(near[2] - 11 / 40) < 0.2 and near[1] == near[2]


def test_native_plan(odd):
    plan = weighted.fingerprints(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowScan", "")


def test_slices_by_two_steps(spark):
    cuts = list(range(10, 500, 7))
    plain = slices.KeySlices(cuts, [0] * len(cuts), 1)
    keys = spark.range(521).select(F.when(F.col("id") < 520, F.col("id")).alias("id"), F.col("id").cast("string").alias("t"))
    rows = keys.select("id", plain.slice(F.col("id"), F.col("t")).alias("s")).collect()
    assert all(r["s"] == (len(cuts) + 1 if r["id"] is None else sum(c <= r["id"] for c in cuts)) for r in rows)
    hot = slices.KeySlices([10, 20], [0, 3], 2)
    assert hot.order.tolist() == [0, 1, 2, 2, 2, 3, 4, 4]
    got = {(r["id"], r["s"]) for r in keys.select("id", hot.slice(F.col("id"), F.col("t")).alias("s")).collect()}
    assert all(s in {None: (6, 7), 20: (2, 3, 4)}.get(i, ((0 if i < 10 else 1 if i < 20 else 5) if i is not None else 0,)) for i, s in got)
    assert slices.KeySlices([], [], 1).n == 2
