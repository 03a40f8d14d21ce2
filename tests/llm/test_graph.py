import numpy as np
import pytest

from shopledger.llm import graph
from shopledger.llm.queries import op9_embedding_neighbours


def brute(rows, limit=0.93):
    """(id, vector, label) rows -> sorted (id, links, component) over all pairs."""
    n = len(rows)
    unit = []
    for key, v, label in rows:
        ok = key is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    links, root = [0] * n, list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= limit:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    lowest = {}
    for i in range(n):
        if rows[i][0] is not None:
            lowest[top(i)] = min(lowest.get(top(i), 1 << 62), rows[i][0])
    return sorted(((rows[i][0], links[i], lowest.get(top(i))) for i in range(n)), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)


def found(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def clustered(rng, families, size, dims=16, noise=0.1):
    out = []
    for f in range(families):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        out += [(centre + noise * rng.normal(size=dims) / np.sqrt(dims), f % 2) for _ in range(size)]
    return [(i, v.tolist(), label) for i, (v, label) in enumerate(out)]


def test_families_loners_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 8, 12) + [(1000 + i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(30)] + [(3000, rows[0][1], 1)]
    assert found(graph.linked(frame(spark, rows))) == brute(rows)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 60)
    rows = clustered(np.random.default_rng(2), 30, 20, noise=0.2)
    got, want = found(graph.linked(frame(spark, rows))), brute(rows)
    links = sum(min(a[1], b[1]) for a, b in zip(got, want, strict=True))
    assert links >= 0.9 * sum(w[1] for w in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))  # none below the limit


def test_a_family_larger_than_a_shard_stays_whole(spark, monkeypatch):
    """Its vectors have one centroid, so they are one dense shard, which is compared in blocks."""
    monkeypatch.setattr(graph, "SHARD_ROWS", 60)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 70)
    monkeypatch.setattr(graph, "TRIES", 1)
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(16)[0] + 0.2 * rng.normal(size=16) / 4).tolist(), 1) for i in range(500)]
    rows += [(1000 + i, rng.normal(size=16).tolist(), 1) for i in range(200)]
    got, want = found(graph.linked(frame(spark, rows))), brute(rows)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] and g[2] == w[2] for g, w in zip(got, want, strict=True))


def test_labels_of_several_shards(spark):
    """As many vectors as it takes to split a label and a shard of it, with the sizes of production."""
    rng = np.random.default_rng(12)
    rows = clustered(rng, 400, 6, dims=32, noise=0.25) + clustered(rng, 2, 150, dims=32, noise=0.25)
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(rows)] + [(10_000 + i, rng.normal(size=32).tolist(), 0) for i in range(5000)]
    table = frame(spark, rows)
    reps = table.select(table.label, graph.unit_bytes(table.embedding).alias("unit"), table.vec_id.alias("rep")).selectExpr("*", "1L AS copies", "rep AS low")
    shards = graph._sharded(reps, graph.OVERLAP, 0.93).groupBy("shard").count().collect()
    assert len(shards) >= 5 and max(r["count"] for r in shards) <= graph.SHARD_ROWS
    got, want = found(graph.linked(table)), brute(rows)
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_a_pair_counts_in_its_first_shared_shard():
    one, other = graph._table([[4, 7], [2], [9, 11, 12]]), graph._table([[7, 8], [2, 3], [1]])
    most = np.iinfo(np.int64).max
    assert graph._first_shared(one, other).tolist() == [7, 2, most]
    assert graph._first_shared(one[:, None], other[None]).tolist() == [[7, most, most], [most, 2, most], [most, most, most]]


def test_centroids_do_not_cut_what_is_linked():
    rng = np.random.default_rng(6)
    x = np.concatenate([np.eye(24)[0] + 0.02 * rng.normal(size=(900, 24)), rng.normal(size=(300, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = graph.centroids(x, 12)
    assert 2 <= len(c) < 12 and np.triu(c @ c.T, 1).max() < 0.93
    child, near = graph.children(x, c, 2, 0.93)
    assert len(np.unique(child[:900, 0])) == 1 and (child[:, 0] >= 0).all() and (np.diff(near, axis=1) <= 0).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (6, [1.0, 0.0], None)]
    rows += [(7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1e300, 1e290], 1), (None, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1)]
    df = graph.linked(frame(spark, rows))
    assert found(df) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in df.collect())


def test_text_keys(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0], "x"), ("a", [1.0, 0.01], "x"), ("c", [0.0, 1.0], "x"), (None, [1.0, 0.0], "x")], "vec_id string, embedding array<double>, label string")
    assert sorted((tuple(r) for r in graph.linked(rows).collect()), key=str) == sorted([("b", 1, "a", False), ("a", 1, "a", True), ("c", 0, "c", True), (None, 0, None, True)], key=str)


def test_extra_columns_and_empty_table(spark):
    rows = frame(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)])
    clash = rows.selectExpr("*", "1 AS rep", "2 AS unit", "3 AS id", "4 AS n_links")
    assert found(graph.linked(clash)) == [(1, 1, 1), (2, 1, 1)]
    assert graph.linked(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 700])
def test_search_finds_what_brute_force_finds(n):
    rng = np.random.default_rng(n)
    x = np.array([v for _, v, _ in clustered(rng, max(1, n // 50), 50)])[:n]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = graph.range_pairs(x, graph.build(x.astype(np.float32)), 0.93)
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True)}
    assert {tuple(p) for p in pairs.tolist()} <= true and len(pairs) >= 0.97 * len(true)


def test_pruning_keeps_directions():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0.6, -0.8]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert graph.prune_all(x, np.array([0]), np.array([[1, 2, 3, -1, 2, 0]]), 2, 1.2).tolist() == [[1, 3]]


def test_pruning_of_many_equals_one_by_one():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = rng.integers(-1, 60, (30, 20))
    for node, own in enumerate(lists):
        left = sorted({int(i) for i in own if i >= 0 and i != node}, key=lambda i: -(x[i] @ x[node]))
        kept = []
        for i in left:
            if len(kept) < 6 and all(1.2 * np.linalg.norm(x[i] - x[k]) > np.linalg.norm(x[i] - x[node]) for k in kept):
                kept.append(i)
        assert [i for i in graph.prune_all(x, np.arange(30), lists, 6, 1.2)[node].tolist() if i >= 0] == kept


def test_audit_sees_missing_links(spark):
    rows = frame(spark, clustered(np.random.default_rng(3), 2, 10, noise=0.05))
    reps = rows.select(rows.label, graph.unit_bytes(rows.embedding).alias("unit"), rows.vec_id.alias("rep")).selectExpr("*", "1 AS copies")
    right = reps.selectExpr("rep", "9L AS links")
    assert graph.audit(reps, right, 0.93) == 1.0
    assert graph.audit(reps, reps.selectExpr("rep", "3L AS links"), 0.93) < 0.5


def test_audit_sees_small_families_beside_a_hot_one(spark):
    rows = clustered(np.random.default_rng(8), 1, 200, noise=0.05) + [(1000 + i, v, 0) for i, v, _ in clustered(np.random.default_rng(9), 20, 2, noise=0.05)]
    rows = frame(spark, rows)
    reps = rows.select(rows.label, graph.unit_bytes(rows.embedding).alias("unit"), rows.vec_id.alias("rep")).selectExpr("*", "1 AS copies")
    assert graph.audit(reps, reps.selectExpr("rep", "if(rep < 1000, 199L, 1L) AS links"), 0.93) == 1.0
    assert graph.audit(reps, reps.selectExpr("rep", "if(rep < 1000, 199L, 0L) AS links"), 0.93) < 0.5


def test_labels_below_the_recall_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(graph, "TRIES", 1)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 30)
    rows = clustered(np.random.default_rng(7), 4, 50, noise=0.2)

    def nothing(members, adjacency, limit, beam):
        return members.selectExpr("rep", "0L AS links", "rep AS root")

    monkeypatch.setattr(graph, "_found", nothing)
    assert found(graph.linked(frame(spark, rows))) == brute(rows)


def test_query(spark, small):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert found(op9_embedding_neighbours(spark, small)) == brute(rows)
