"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label and of cosine ``LIMIT`` or more are linked. Equal vectors are compared once, as one
representative with a number of copies.

* Shards: a label is split again and again, each large shard by centroids of a sample of its own, until a shard has
  ``SHARD_ROWS`` members at most. A vector is at home with its nearest centroid, and a visitor of the nearest others whose
  border with that one is within the radius of a link, ``OVERLAP`` in all. Centroids that are themselves
  within the radius of a link become one, so that a family of near copies is not cut however large it is; a
  large shard that has a single centroid left is dense.
* Build: on each shard, homes and visitors together, a flat graph grows by batches: a greedy beam search from
  the medoid finds candidates for each new vector, robust pruning keeps near ones in different directions
  (a candidate goes if a kept one is nearer to it, by a factor, than the vector itself), and back links are added.
* Union: the adjacency lists that a vector got in different shards become one.
* Search: each member of a shard searches from the medoid; once vectors within the limit turn up, the search
  expands over all of them and their neighbours until no new one is found. Every candidate is verified in double precision.
  A pair counts for both sides, in the first of the shards that both are members of.
* Dense shards: nearly all of their vectors are linked with each other, so a search would visit all of them. They are
  compared in blocks of ``BLOCK_ROWS`` vectors by as many: work in proportion to the links that are counted.
* Audit: links of a uniform sample of vectors are compared with brute force over all rows; below ``RECALL``, in all, for each
  vector, or for small families or hot ones alone, the search is repeated with twice the overlap and beam, so the audit
  chooses them. Labels
  that the last try has not shown to reach it are compared exactly, in blocks.

Shards return for each vector its number of links and one root, not its pairs, so rows grow with the vectors only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .components import components

LIMIT = 0.93
SHARD_ROWS = 2000  # members of a shard, visitors included
FAN, FIT_ROWS = 32, 64  # children of a shard that is split, at most; vectors of the sample for each child
LEVELS = 12  # of splits: FAN^LEVELS shards
OVERLAP, DEGREE, BEAM, ALPHA = 1, 24, 32, 1.2
RING = 0.05  # cosine below the limit down to which a search expands
BATCH = 512
BLOCK_ROWS = 4096  # vectors on a side of an exact comparison
AUDIT_ROWS, RECALL, TRIES = 2048, 0.9, 3
SMALL = 16  # links of a vector of a small family, below
KEY = ["label", "wide", "shard"]


def unit_bytes(embedding: Column) -> Column:
    """The vector at length 1 as little-endian doubles; null if it is null, empty, zero or holds a null or non-finite number."""

    @F.arrow_udf("binary")
    def units(column: pa.Array) -> pa.Array:
        out = []
        for value in column.cast(pa.list_(pa.float64())):
            numbers = value.values
            if numbers is None or not len(numbers) or numbers.null_count:
                out.append(None)
                continue
            x = numbers.to_numpy(zero_copy_only=False)
            top = np.abs(x).max()
            if not np.isfinite(x).all() or top == 0:
                out.append(None)
                continue
            x = x / top  # against overflow of the squares
            out.append((x / np.sqrt(x @ x) + 0.0).astype("<f8").tobytes())
        return pa.array(out, pa.binary())

    return units(embedding)


def matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def centroids(x: np.ndarray, k: int, limit: float = LIMIT, rounds: int = 8) -> np.ndarray:
    """Up to k directions from unit vectors, by rounds of assignment and mean from a fixed start.

    Of directions with a cosine of ``limit`` or more one stays, so what is linked has one centroid.
    """
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else x[rng.integers(len(x))] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    kept: list[int] = []
    for j in np.argsort(-sizes, kind="stable").tolist():
        if not kept or (c[kept] @ c[j]).max() < limit:
            kept.append(j)
    return c[sorted(kept)]


def children(x: np.ndarray, c: np.ndarray, overlap: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its nearest centroids (-1 for none) and cosines: the home, then those it visits.

    Of the ``overlap`` nearest others those whose border with the home is within the distance of a link.
    """
    radius = np.sqrt(max(0.0, 2 - 2 * limit)) + 1e-9
    sims = x @ c.T
    near = np.argsort(-sims, axis=1, kind="stable")[:, : overlap + 1]
    best = np.take_along_axis(sims, near, 1)
    # Distance to the plane between two centroids, both of length 1.
    apart = np.maximum(np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))), 1e-12)
    within = (best[:, :1] - best) / apart[near[:, :1], near] <= radius
    within[:, 0] = True
    return np.where(within, near, -1), best


def beam_search(x: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for rows ``queries`` of x: ids (-1 for none) and cosines of the best ``beam`` vectors met."""
    n, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((n, len(x)), bool)
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, x.dtype)
    done = np.zeros((n, beam), bool)
    q = x[queries]
    ids[:, 0], sims[:, 0] = entry, q @ x[entry]
    seen[:, entry] = True
    while True:
        waiting = np.where(done, -np.inf, sims)
        best = waiting.argmax(1)
        rows = np.nonzero(waiting[np.arange(n), best] > -np.inf)[0]
        if not len(rows):
            return ids, sims
        done[rows, best[rows]] = True
        near = links[ids[rows, best[rows]]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        if not len(r):
            continue
        seen[rows[r], near[r, c]] = True
        more = np.full(near.shape, -np.inf, x.dtype)
        more[r, c] = np.einsum("ij,ij->i", q[rows[r]], x[near[r, c]])
        all_ids = np.concatenate([ids[rows], near], 1)
        all_sims = np.concatenate([sims[rows], more], 1)
        all_done = np.concatenate([done[rows], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))


def prune_all(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to ``degree`` candidates (rows of ids, -1 for none), nearest first.

    A candidate goes if a kept one is nearer to it by ``alpha`` than the node is.
    """
    ids = np.sort(candidates, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    ids[ids == nodes[:, None]] = -1
    v = x[np.maximum(ids, 0)]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ijk,ik->ij", v, x[nodes])))
    far[ids < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")[:, : 3 * degree]
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = alpha * np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
    left, rows = ids >= 0, np.arange(len(nodes))
    out = np.full((len(nodes), degree), -1, np.int32)
    for n in range(degree):
        first = left.argmax(1)
        has = left[rows, first]
        if not has.any():
            break
        out[has, n] = ids[has, first[has]]
        left &= between[rows, first] > far
        left[rows, first] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency lists (rows of ids, -1 for none) of a flat graph over unit vectors.

    Grown in doubling batches without the factor, then every vector is inserted again with it.
    """
    n, width = len(x), degree + degree // 2
    links = np.full((n, width), -1, np.int32)
    entry = medoid(x)
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])

    def insert(batch: np.ndarray, alpha: float) -> None:
        found, _ = beam_search(x, links, entry, batch, beam)
        kept = prune_all(x, batch, np.concatenate([found, links[batch]], 1), degree, alpha)
        links[batch] = -1
        links[batch, :degree] = kept
        # Back links: to each kept one from the new ones that keep it, after what it has.
        row, place = np.nonzero(kept >= 0)
        to, back = kept[row, place], batch[row]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        ends, starts, many = np.unique(to, return_index=True, return_counts=True)
        lists = np.full((len(ends), many.max(initial=0)), -1, np.int32)
        lists[np.repeat(np.arange(len(ends)), many), np.arange(len(to)) - np.repeat(starts, many)] = back
        own = np.sort(np.concatenate([links[ends], lists], 1), axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
        full = (own >= 0).sum(1) > width
        fits = -np.sort(-own[~full], axis=1)[:, :width]
        links[ends[~full]] = -1
        links[ends[~full], : fits.shape[1]] = fits
        for at in range(0, int(full.sum()), BATCH):
            part = np.flatnonzero(full)[at : at + BATCH]
            links[ends[part]] = -1
            links[ends[part], :degree] = prune_all(x, ends[part], own[part], degree, alpha)

    at = 1
    while at < n:  # vectors of one batch do not see each other yet
        batch = order[at : at + min(BATCH, at)]
        insert(batch, 1.0)
        at += len(batch)
    for at in range(0, n, BATCH):  # now they do
        insert(order[at : at + BATCH], alpha)
    return links


def range_pairs(x: np.ndarray, links: np.ndarray, limit: float, beam: int = BEAM) -> np.ndarray:
    """Pairs (i, j), i < j, of rows with a cosine of ``limit`` or more that searches from the medoid find."""
    entry, y, out = medoid(x), x.astype(np.float32), []
    loose = limit - RING  # a ring around the range is expanded too; double precision decides what is in it
    # Pruning drops back links from vectors that very many are near to, so expansion follows links both ways.
    node, place = np.nonzero(links >= 0)
    ways = np.unique(np.concatenate([node * len(x) + links[node, place], links[node, place] * np.int64(len(x)) + node]))
    ends, begin = ways % max(1, len(x)), np.searchsorted(ways // max(1, len(x)), np.arange(len(x) + 1))
    for at in range(0, len(x), BATCH):
        queries = np.arange(at, min(len(x), at + BATCH))
        ids, sims = beam_search(y, links, entry, queries, beam)
        seen = np.zeros((len(queries), len(x)), bool)
        r, c = np.nonzero(sims >= loose)
        front = (r, ids[r, c])
        seen[np.arange(len(queries)), queries] = True
        seen[front] = True
        # The vector itself starts the expansion too: its neighbours in the graph are its nearest ones.
        front = (np.concatenate([front[0], np.arange(len(queries))]), np.concatenate([front[1], queries]))
        while len(front[0]):
            next_r, next_n = [], []
            for part in range(0, len(front[0]), 4096):
                r, node = front[0][part : part + 4096], front[1][part : part + 4096]
                many = begin[node + 1] - begin[node]
                own = np.repeat(begin[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
                flat = np.unique(np.repeat(r, many) * len(x) + ends[own])
                rr, nn = flat // len(x), flat % len(x)
                new = ~seen[rr, nn]
                rr, nn = rr[new], nn[new]
                seen[rr, nn] = True
                hit = np.einsum("ij,ij->i", y[queries[rr]], y[nn]) >= loose
                # What is out of range is not in the result: forget it, so that ``seen`` ends as the result.
                next_r.append(rr[hit])
                next_n.append(nn[hit])
                seen[rr[~hit], nn[~hit]] = False
            front = (np.concatenate(next_r), np.concatenate(next_n))
        r, j = np.nonzero(seen)
        i = queries[r]
        for part in range(0, len(i), 65536):
            a, b = i[part : part + 65536], j[part : part + 65536]
            real = (a != b) & (np.einsum("ij,ij->i", x[a], x[b]) >= limit)
            out.append(np.stack([np.minimum(a, b)[real], np.maximum(a, b)[real]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    keys = np.unique(pairs[:, 0].astype(np.int64) * max(1, len(x)) + pairs[:, 1])
    return np.stack([keys // max(1, len(x)), keys % max(1, len(x))], 1)


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest row that each row is connected with."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        for side in (0, 1):
            np.minimum.at(new, root[pairs[:, side]], low)
            np.minimum.at(new, pairs[:, side], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _single(reps: DataFrame) -> DataFrame:
    """Every vector at home in the one shard of its label."""
    columns = ["label", F.octet_length("unit").alias("wide"), F.lit(0).cast("bigint").alias("shard"), "rep", "copies", "unit"]
    return reps.select(*columns, F.lit(True).alias("home"), F.lit(1.0).alias("near"), F.lit(False).alias("dense"))


def _split(members: DataFrame, level: int, overlap: int, limit: float) -> DataFrame | None:
    """``members`` with each large shard split into children, or marked as dense; None if there is no large one."""
    sizes = members.where("not dense").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    sizes = _stored(sizes.where(F.col("_n") > SHARD_ROWS), "sizes")
    if sizes.isEmpty():
        return None
    # A uniform sample of each large shard, of the same size for all.
    share = F.lit((FIT_ROWS * FAN) << 20) / F.col("_n")
    drawn = members.join(sizes, KEY).where(F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 20)) < share)

    def fit(table: pa.Table) -> pa.Table:
        k = min(FAN, 2 * -(-table.column("_n")[0].as_py() // SHARD_ROWS))
        c = centroids(matrix(sorted(table.column("unit").to_pylist())), k, limit)
        own = table.select(KEY).slice(0, 1)
        return own.append_column("centres", pa.array([[x.tobytes() for x in c]], pa.list_(pa.binary())))

    kind = members.schema["label"].dataType.simpleString()
    centres = drawn.select(*KEY, "unit", "_n").groupBy(*KEY).applyInArrow(fit, f"label {kind}, wide int, shard bigint, centres array<binary>")
    centres = _stored(centres, "centres")

    @F.arrow_udf("array<struct<child:int,near:double>>")
    def places(units: pa.Array, lists: pa.Array) -> pa.Array:
        groups: dict = {}
        for i, (unit, own) in enumerate(zip(units.to_pylist(), lists.to_pylist(), strict=True)):
            groups.setdefault(tuple(own), []).append((i, unit))
        out: list = [None] * len(units)
        for own, rows in groups.items():
            for at in range(0, len(rows), 2048):
                part = rows[at : at + 2048]
                child, near = children(matrix([u for _, u in part]), matrix(own), overlap, limit)
                for (i, _), cs, ns in zip(part, child.tolist(), near.tolist(), strict=True):
                    out[i] = [{"child": c, "near": n} for c, n in zip(cs, ns, strict=True) if c >= 0]
        return pa.array(out, pa.list_(pa.struct([("child", pa.int32()), ("near", pa.float64())])))

    # Few shards are large, and their centroids are small next to their vectors; the planner knows the size of the stored table.
    met = members.join(centres, KEY, "left")
    stay = met.where(F.col("centres").isNull() | (F.size("centres") < 2))
    stay = stay.withColumn("dense", F.col("dense") | F.col("centres").isNotNull()).select(*members.columns)
    split = met.where(F.size("centres") > 1).select(*members.columns, F.posexplode(places("unit", "centres")).alias("_p", "_c"))
    split = split.select(
        "label", "wide", (F.col("shard") * FAN + F.col("_c.child") + 1).alias("shard"), "rep", "copies", "unit",
        (F.col("home") & (F.col("_p") == 0)).alias("home"), F.col("_c.near").alias("near"), F.lit(False).alias("dense"),
    )
    # Of the shards that a vector could visit the nearest ones stay.
    order = Window.partitionBy("rep").orderBy(F.col("home").desc(), F.col("near").desc(), "shard")
    every = stay.unionByName(split).withColumn("_r", F.row_number().over(order))
    return _stored(every.where(F.col("_r") <= overlap + 1).drop("_r"), "members")


def _sharded(reps: DataFrame, overlap: int, limit: float) -> DataFrame:
    """Rows (label, wide, shard, rep, copies, unit, dense, shards): members of each shard, with all shards of the vector."""
    members = _stored(_single(reps), "members")
    for level in range(LEVELS):
        after = _split(members, level, overlap, limit)
        if after is None:
            break
        members = after
    all_of = Window.partitionBy("rep")
    columns = [*KEY, "rep", "copies", "unit", "dense", F.sort_array(F.collect_list("shard").over(all_of)).alias("shards")]
    return _stored(members.select(*columns), "members")


def _table(lists: list[list[int]]) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=1)), -1, np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def _first_shared(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least number in both rows of two tables of shards (padded with -1), rows being paired as they broadcast."""
    best = np.full(np.broadcast_shapes(one.shape[:-1], other.shape[:-1]), np.iinfo(np.int64).max)
    for a in np.moveaxis(one, -1, 0):
        for b in np.moveaxis(other, -1, 0):
            best = np.where((a == b) & (a >= 0) & (a < best), a, best)
    return best


def compared(x: np.ndarray, y: np.ndarray, limit: float, allowed) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Pairs of a row of x and one of y: links that connect what all of them connect (rows of y after those of x), and parts of the hits.

    ``allowed`` (a slice of x) tells which pairs of those rows count, as a matrix.
    """
    links, parts = [np.zeros((0, 2), np.int64)], []
    for at in range(0, len(x), BATCH):
        part = slice(at, min(len(x), at + BATCH))
        hit = (x[part] @ y.T >= limit) & allowed(part)
        r, c = np.nonzero(hit)
        parts.append((r + at, c))
        # A row of y is linked with its first row of x, and the rows of x that share one with the first.
        first = hit.argmax(0)
        shared = np.zeros((len(hit), len(hit)), bool)
        shared[r, first[c]] = True
        met = np.unique(c)
        links += [np.stack([first[met] + at, met + len(x)], 1), np.stack(np.nonzero(shared), 1) + at]
    return np.concatenate(links), parts


def _counts(a: pa.Table, b: pa.Table, links: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Number of rows linked and the smallest row reached, for the linked rows of two tables that were compared."""
    copies, others = a.column("copies").to_numpy(), b.column("copies").to_numpy()
    left, right = np.zeros(len(copies), np.int64), np.zeros(len(others), np.int64)
    for r, c in parts:
        np.add.at(left, r, others[c])
        np.add.at(right, c, copies[r])
    reps, count = np.concatenate([a.column("rep").to_numpy(), b.column("rep").to_numpy()]), np.concatenate([left, right])
    root = roots(len(reps), links)
    hit = count > 0
    return pa.table({"rep": pa.array(reps[hit], pa.int64()), "links": pa.array(count[hit], pa.int64()), "root": pa.array(reps[root[hit]], pa.int64())})


def _exact(members: DataFrame, limit: float) -> DataFrame:
    """(rep, links, root) from an exact comparison of all members of each shard, in blocks.

    A pair counts in the first shard of both. Members are dealt into parts; each pair of parts is one block, so a member
    is sent as often as its shard has parts.
    """
    sizes = _stored(members.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")), "blocks")
    own = members.join(sizes, KEY).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(4)), F.col("parts")).cast("int"))
    columns = [*KEY, "part", "row", "rep", "copies", "unit", "shards"]

    def dealt(side: str, other: str, upper: bool) -> DataFrame:
        """Each member is on the left of the parts from its own on, and on the right of those up to its own."""
        span = F.sequence(F.col("own"), F.col("parts") - 1) if upper else F.sequence(F.lit(0), F.col("own"))
        return own.withColumn(side, F.col("own")).withColumn(other, F.explode(span)).select(*columns).toDF(*columns)

    def compare(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("rep", "links", "root")})
        x, y = (matrix(t.column("unit").to_pylist()) for t in (a, b))
        first, second = (t.column("rep").to_numpy() for t in (a, b))
        mine, theirs = (_table(t.column("shards").to_pylist()) for t in (a, b))
        same = key[3].as_py() == key[4].as_py()

        def allowed(part: slice) -> np.ndarray:
            ok = _first_shared(mine[part, None], theirs[None]) == key[2].as_py()
            return ok & (first[part, None] < second[None]) if same else ok

        links, parts = compared(x, y, limit, allowed)
        return _counts(a, b, links, parts)

    left, right = dealt("row", "part", True), dealt("part", "row", False)
    by = [*KEY, "part", "row"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "rep bigint, links bigint, root bigint")


def _adjacency(members: DataFrame, degree: int, beam: int) -> DataFrame:
    """Union of the adjacency lists of all shards: (rep, near)."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        reps = table.column("rep").to_numpy()
        links = build(matrix(table.column("unit").to_pylist()).astype(np.float32), degree, beam)
        ends = pa.array(np.concatenate([[0], np.cumsum((links >= 0).sum(1))]), pa.int32())
        return pa.table({"rep": pa.array(reps, pa.int64()), "near": pa.ListArray.from_arrays(ends, pa.array(reps[links[links >= 0]], pa.int64()))})

    lists = members.select(*KEY, "rep", "unit").groupBy(*KEY).applyInArrow(grow, "rep bigint, near array<bigint>")
    # A vector is in OVERLAP + 1 shards at most, so its united list is short.
    return lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _found(members: DataFrame, adjacency: DataFrame, limit: float, beam: int) -> DataFrame:
    """(rep, links, root) for each member of a shard: rows linked within it, and the smallest one connected there."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        shard, shards = table.column("shard")[0].as_py(), _table(table.column("shards").to_pylist())
        lists = table.column("near").combine_chunks()
        many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        near, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(reps)), many)
        place = np.minimum(np.searchsorted(reps, near), len(reps) - 1)
        here = reps[place] == near  # neighbours in other shards are no rows of this table
        row, place = row[here], place[here]
        many = np.bincount(row, minlength=len(reps))
        links = np.full((len(reps), max(1, many.max(initial=1))), -1, np.int32)
        links[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = place
        pairs = range_pairs(matrix(table.column("unit").to_pylist()), links, limit, beam)
        own = np.concatenate([_first_shared(shards[p[:, 0]], shards[p[:, 1]]) == shard for p in np.array_split(pairs, 1 + len(pairs) // 200_000)])
        count = np.zeros(len(reps), np.int64)
        for a, b in ((0, 1), (1, 0)):
            np.add.at(count, pairs[own, a], copies[pairs[own, b]])
        root = reps[roots(len(reps), pairs[own])]
        return pa.table({"rep": pa.array(reps, pa.int64()), "links": pa.array(count, pa.int64()), "root": pa.array(root, pa.int64())})

    rows = members.join(adjacency, "rep", "left").select(*KEY, "rep", "copies", "unit", "shards", "near")
    return rows.groupBy(*KEY).applyInArrow(search, "rep bigint, links bigint, root bigint")


def sampled(reps: DataFrame, counted: DataFrame, limit: float, rows: int = AUDIT_ROWS) -> list[tuple]:
    """(label, width, links found, links by brute force over all rows) of a uniform sample of vectors that have links.

    The sample, a fixed number of vectors, goes to every block of rows; each block returns one count for each.
    """
    mark = F.xxhash64("rep", F.lit(2))
    drawn = reps.select("rep", "label", "unit").orderBy(mark, "rep").limit(rows)
    sample = drawn.join(counted, "rep", "left").select("rep", "label", "unit", F.coalesce("links", F.lit(0)).alias("links")).collect()
    groups: dict = {}
    for r in sample:
        groups.setdefault((r["label"], len(r["unit"])), []).append(r)
    blocks = {k: (np.array([r["rep"] for r in v]), matrix([bytes(r["unit"]) for r in v])) for k, v in groups.items()}

    def count(batches):
        for batch in batches:
            found: dict[int, int] = {}
            rows: dict = {}
            for i, (label, unit) in enumerate(zip(batch.column("label").to_pylist(), batch.column("unit").to_pylist(), strict=True)):
                rows.setdefault((label, len(unit)), []).append((i, unit))
            copies, reps_here = batch.column("copies").to_numpy(), batch.column("rep").to_numpy()
            for key, own in rows.items():
                if key in blocks:
                    ids, q = blocks[key]
                    at = np.array([i for i, _ in own])
                    hit = (q @ matrix([u for _, u in own]).T >= limit) & (ids[:, None] != reps_here[at][None, :])
                    for rep, n in zip(ids.tolist(), (hit * copies[at]).sum(1).tolist(), strict=True):
                        found[rep] = found.get(rep, 0) + n
            yield pa.RecordBatch.from_pydict({"rep": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    true = {r["rep"]: r["n"] for r in reps.select("rep", "label", "copies", "unit").mapInArrow(count, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    return [(r["label"], len(r["unit"]), min(r["links"], true[r["rep"]]), true[r["rep"]]) for r in sample if true.get(r["rep"])]


def recall(sample: list[tuple]) -> float:
    """The least of: links found of all links, the mean of that for each vector, and the mean for small families and for hot ones."""
    kinds = [sample, [r for r in sample if r[3] < SMALL], [r for r in sample if r[3] >= SMALL]]
    means = [sum(r[2] / r[3] for r in rows) / len(rows) for rows in kinds if rows]
    return min([1.0, *means, *([sum(r[2] for r in sample) / sum(r[3] for r in sample)] if sample else [])])


def audit(reps: DataFrame, counted: DataFrame, limit: float, rows: int = AUDIT_ROWS) -> float:
    """Recall of links on a uniform sample; see ``sampled`` and ``recall``."""
    return recall(sampled(reps, counted, limit, rows))


def _with_exact(reps: DataFrame, found: DataFrame, sample: list[tuple], limit: float) -> DataFrame:
    """``found`` with the labels whose own sample does not show the required recall searched exactly instead."""
    groups: dict = {}
    for r in sample:
        groups.setdefault(r[:2], []).append(r)
    shown = [k for k, rows in groups.items() if recall(rows) >= RECALL]
    rows = reps.withColumn("wide", F.octet_length("unit"))
    good = reps.sparkSession.createDataFrame(shown, rows.select("label", "wide").schema)
    left = _stored(rows.join(good, ["label", "wide"], "left_anti").select(*reps.columns), "vectors")
    none = left.select("rep", F.lit(0).cast("bigint").alias("links"), F.col("rep").alias("root"))
    whole = _single(left).withColumn("shards", F.array("shard"))
    return found.join(left.select("rep"), "rep", "left_anti").unionAll(none).unionAll(_exact(whole, limit))


def linked(vectors: DataFrame, limit: float = LIMIT, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors link if labels are equal and not null and the cosine is ``limit`` or more; vectors that are null,
    empty, zero, of another length, or hold null or non-finite numbers link with nothing, nor do rows without a key.
    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest key
    reachable; ``kept`` marks the rows that are their own component's. Rows of one key are rows of their own. Keys are of
    any type with an order; other columns do not matter; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), unit_bytes(F.col(embedding)).alias("unit"))
    rows = _stored(rows, "vectors")
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("unit").isNotNull()
    same = rows.where(usable).groupBy("label", "unit").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    reps = _stored(same.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    overlap, beam = OVERLAP, BEAM
    for left in range(TRIES - 1, -1, -1):
        members = _sharded(reps, overlap, limit)
        sparse = members.where("not dense")
        found = _found(sparse, _adjacency(sparse, DEGREE, beam), limit, beam)
        found = _stored(found.unionAll(_exact(members.where("dense"), limit)), "found")
        counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
        sample = sampled(reps, counted, limit)
        if recall(sample) >= RECALL:
            break
        if not left:
            found = _stored(_with_exact(reps, found, sample, limit), "found")
            counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
            break
        overlap, beam = 2 * overlap, 2 * beam
    joined = components(found.where("rep <> root").select("rep", "root").distinct(), "rep", "root")
    joined = joined.select(F.col("node").alias("rep"), "root")
    named = _stored(reps.join(counted, "rep", "left").join(joined, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "named")
    # The smallest key of a component: combined before the shuffle, so a large component is no hot group.
    first = named.groupBy("root").agg(F.min("low").alias("_first"))
    named = named.join(first, "root").select(
        F.col("label").alias("_label"), F.col("unit").alias("_unit"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), "_first"
    )
    out = rows.join(named, usable & (F.col("label") == F.col("_label")) & (F.col("unit") == F.col("_unit")), "left")
    first = F.coalesce("_first", "id")
    return out.select(F.col("id").alias(key), F.coalesce("_links", F.lit(0)).alias("n_links"), first.alias("component_id"), F.col("id").eqNullSafe(first).alias("kept"))
