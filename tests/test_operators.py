"""Operators against brute force; skew paths are forced with a low row limit."""

import datetime as dt
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import d, rows
from shopledger.operators import labels, merge, pairs, ranking, selection, sequences, skew, trailing
from shopledger.sources import sinks


def hot_rows(spark, n=3000):
    """A third of the rows under one key, a third under NULL, the rest spread."""
    return spark.range(n).select(
        F.format_string("r%05d", "id").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 % 40).cast("int")).alias("day"),
        (F.col("id") * 13 % 101).alias("v"),
    )


def test_heavy_keys_are_bounded_and_include_null(spark):
    heavy = dict(skew.heavy_keys(hot_rows(spark), "k", min_rows=100, share=0.1).parts)
    assert set(heavy) == {"hot", None}
    assert heavy["hot"] == 10  # 1000 rows at no more than 100 per part
    assert not skew.heavy_keys(hot_rows(spark), "k")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_plain_join(spark, how):
    left = hot_rows(spark)
    lookup = left.select("k").distinct().where("k is null or k <> 'k2'").withColumn("name", F.upper("k"))
    plain = left.join(lookup, "k", how).select("id", "k", "name")
    spread = skew.spread_join(left, lookup, "k", "id", how, min_rows=50, share=0.01).select("id", "k", "name")
    assert rows(spread) == rows(plain)


def test_a_key_below_a_small_share_is_split_once_it_exceeds_the_limit(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") < 15, F.lit("warm")).otherwise(F.col("id").cast("string")).alias("k"))
    assert dict(skew.heavy_keys(frame, "k", min_rows=10).parts) == {"warm": 2}


def test_heavy_keys_of_no_rows(spark):
    assert not skew.heavy_keys(spark.createDataFrame([], "k string"), "k", min_rows=1)


def test_spread_join_deals_a_hot_key_over_tasks(spark):
    left = hot_rows(spark)
    heavy = skew.heavy_keys(left, "k", min_rows=50, share=0.01)
    dealt = skew.with_parts(left, heavy, "k").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")))
    sizes = [r["count"] for r in dealt.where("k = 'hot'").groupBy("p").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 150


@pytest.mark.parametrize("slices", [1, 3, 40])
@pytest.mark.parametrize("one_day", [False, True])
def test_with_previous_in_slices_equals_plain_window(spark, one_day, slices):
    frame = hot_rows(spark).withColumn("day", F.when(F.col("v") != 5, F.col("day")))  # some NULL days
    if one_day:  # all rows of the heavy keys on a single day
        frame = frame.withColumn("day", F.lit("2024-01-01").cast("date"))
    args = dict(key="k", day="day", tie="id", number="n", previous={"pv": "v", "pd": "day"}, distinct={"dv": "v"})
    cut = sequences.with_previous(frame, **args, slices=slices)
    w = Window.partitionBy("k").orderBy(F.col("day").asc_nulls_last(), "id")
    plain = frame.select(
        "*", F.row_number().over(w).cast("bigint").alias("n"), F.lag("v").over(w).alias("pv"), F.lag("day").over(w).alias("pd"),
        F.size(F.collect_set("v").over(Window.partitionBy("k"))).cast("bigint").alias("dv"),
    )
    assert rows(cut) == rows(plain)


def test_with_previous_keeps_null_values_of_the_row_before(spark):
    frame = spark.createDataFrame([("a", d("2024-01-01"), "1", None), ("a", d("2024-01-02"), "2", 5), ("a", d("2024-01-02"), "3", 6)], "k string, day date, id string, v int")
    for slices in (1, 3):
        got = sequences.with_previous(frame, "k", "day", "id", "n", {"p": "v"}, slices=slices)
        assert rows(got, "id", "n", "p") == [("1", 1, None), ("2", 2, None), ("3", 3, 5)]


@pytest.mark.parametrize("seed", range(3))
def test_sequences_go_on_from_stored_ends(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", "c", None, f"k{i % 50}"]), i // 9 if i < 300 else None, f"t{i:04d}", rng.choice([None, i]), rng.choice("xyz")) for i in range(330)]
    frame = spark.createDataFrame(data, "k string, day int, id string, v int, c string")
    args = dict(key="k", day="day", tie="id", number="n", previous={"p": "v", "pd": "day"}, distinct={"u": "c"})
    parts = [frame.where("day < 12"), frame.where("day >= 12 and day < 25"), frame.where("day >= 25 or day is null")]
    rows_of = [sequences.with_previous(parts[0], **{a: x for a, x in args.items() if a != "distinct"})]
    ends = sequences.sequence_ends(rows_of[0], **args)
    for i, part in enumerate(parts[1:]):
        new, ends = sequences.continued(ends, part, **args)
        rows_of.append(new)
        ends.write.parquet(str(tmp_path / f"ends{i}"))
        ends = spark.read.parquet(str(tmp_path / f"ends{i}"))
    numbered = rows_of[0].union(rows_of[1]).union(rows_of[2])
    sizes = sequences.distinct_sizes(ends.withColumnRenamed("k", "key"), "key", args["distinct"])
    got = numbered.join(sizes, F.col("k").eqNullSafe(F.col("key")), "left").drop("key")
    want = sequences.with_previous(frame, **args)
    assert rows(got, *want.columns) == rows(want)
    with pytest.raises(ValueError):
        sequences.continued(ends, parts[1], **args)


def brute_partners(lines):
    groups = defaultdict(list)
    for g, i in lines:
        groups[g].append(i)
    together, size, seen = Counter(), Counter(), Counter()
    for items in groups.values():
        unique = sorted(set(items))
        for a, b in combinations(unique, 2):
            together[a, b] += 1
            together[b, a] += 1
        for i in items:
            size[i] += len(unique)
            seen[i] += 1
    out = []
    for i in seen:
        best = min(((-n, b) for (a, b), n in together.items() if a == i), default=(None, None))
        out.append((i, best[1], None if best[0] is None else -best[0], size[i] / seen[i]))
    return sorted(out)


def spark_partners(spark, lines, **options):
    frame = spark.createDataFrame(lines, "g string, i string")
    got = pairs.top_partners(frame, "g", "i", **options).select("i", "partner", "together", "mean_group_size")
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("wide", [1, 3, 5, 256])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_partners_equals_brute_force(spark, wide, seed):
    rnd = random.Random(seed)
    lines = [(f"g{rnd.randrange(25)}", f"i{rnd.randrange(12)}") for _ in range(160)]
    lines += [("big", f"i{n}") for n in range(0, 14)] * 2  # one group with every item, and two new ones
    lines += [("alone", "solo")]
    assert spark_partners(spark, lines, wide=wide, min_rows=10) == brute_partners(lines)


@pytest.mark.parametrize("seed", range(3))
def test_wide_groups_by_small_tiles(spark, seed):
    rng = random.Random(seed)
    lines = [(f"g{int(rng.paretovariate(0.8)) % 40}", f"i{rng.randint(0, 60):02d}") for _ in range(900)]
    spark.conf.set("spark.shopledger.tileItems", "7")
    try:
        assert spark_partners(spark, lines, wide=6, min_rows=50) == brute_partners(lines)
    finally:
        spark.conf.unset("spark.shopledger.tileItems")


def test_thousands_of_different_wide_groups(spark, monkeypatch):
    """No two items share a set of groups; tiles see a part of each group, and only best partners leave them."""
    monkeypatch.setattr(pairs, "PAIRS", 1000)
    rng = random.Random(9)
    lines = sorted({(f"g{g}", f"i{int(400 * rng.random() ** 2):03d}") for g in range(2500) for _ in range(14)})
    spark.conf.set("spark.shopledger.tileItems", "90")
    try:
        assert spark_partners(spark, lines, wide=8, min_rows=10**6) == brute_partners(lines)
    finally:
        spark.conf.unset("spark.shopledger.tileItems")


def test_tiles_follow_the_pairs_that_meet_where_most_items_never_do(spark, monkeypatch):
    """Many items in small wide groups: the tiles are few and their cells many, most of them empty."""
    blocks = pairs._blocks
    assert blocks(1_000_000, 2_000_000, 20_000_000, 1024, 4_000_000) <= 5  # by items: 977 blocks, 477,753 tiles
    assert blocks(10_000_000, 20_000_000, 200_000_000, 1024, 4_000_000) <= 14
    assert blocks(5_000, 50_000_000, 10**12, 1024, 4_000_000) == 25 and blocks(3000, 3000, 9_000_000, 1024, 4_000_000) == 3
    monkeypatch.setattr(pairs, "DENSE", 10)
    monkeypatch.setattr(pairs, "PAIRS", 50)
    rng = random.Random(4)
    lines = [(f"g{g:03d}", f"i{rng.randrange(600):03d}") for g in range(150) for _ in range(rng.choice([2, 3, 9, 12]))]
    spark.conf.set("spark.shopledger.tileItems", "20")
    try:
        assert spark_partners(spark, lines, wide=5, min_rows=10) == brute_partners(lines)
    finally:
        spark.conf.unset("spark.shopledger.tileItems")


def test_top_partners_of_one_huge_group_emits_no_pairs(spark):
    """One group holds most rows. Its 3000 items would give 4.5 million pairs."""
    lines = [("huge", f"i{n:04d}") for n in range(3000)] + [("a", "i0007"), ("a", "i0009"), ("b", "i0007"), ("b", "i0009")]
    got = {r[0]: r[1:3] for r in spark_partners(spark, lines, wide=50, min_rows=100)}
    assert got["i0007"] == ("i0009", 3) and got["i0009"] == ("i0007", 3)
    assert got["i0000"] == ("i0001", 1) and got["i0001"] == ("i0000", 1) and got["i2999"] == ("i0000", 1)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("uvwxyz")), min_size=1, max_size=30), wide=st.integers(1, 8))
def test_top_partners_property(spark, lines, wide):
    assert spark_partners(spark, lines, wide=wide, min_rows=3) == brute_partners(lines)


def test_top_partners_without_wide_groups_counts_no_group_again(spark):
    lines = [("g", "b"), ("g", "a"), ("g", "b"), ("h", "a"), ("h", "b"), ("k", "c"), ("k", "c")]
    assert spark_partners(spark, lines) == brute_partners(lines)
    plan = pairs.top_partners(spark.createDataFrame(lines, "g string, i string"), "g", "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_most_frequent_breaks_ties_by_value(spark):
    frame = spark.createDataFrame([("a", "y", 2), ("a", "x", 2), ("a", None, 2), ("b", "z", 1), ("b", "w", 3)], "k string, v string, n int")
    assert rows(ranking.most_frequent(frame, "k", "v", "n", "top")) == [("a", "x"), ("b", "w")]


@pytest.mark.parametrize("most", [1, 63])
def test_label_list(spark, most):
    frame = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("a", None), ("b", None), ("c", "z")], "k string, v string")
    known = labels.known_labels(frame, "v", most)
    assert known == (["x", "y", "z"] if most == 63 else None)
    listed = labels.LabelList(known)
    got = frame.withColumn("c", listed.encode(F.col("v"))).groupBy("k").agg(listed.combine(F.col("c")).alias("s"))
    joined = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string").join(got, "k", "left")
    assert rows(joined.select("k", listed.text(F.col("s")).alias("t"))) == [("a", "x, y"), ("b", ""), ("c", "z"), ("d", None)]


def test_earliest_puts_null_last(spark):
    frame = spark.createDataFrame(
        [("a", None, "s1", "p"), ("a", d("2024-02-01"), "s3", "q"), ("a", d("2024-02-01"), "s2", "r"), ("b", None, "s9", None)],
        "k string, day date, id string, x string",
    )
    got = ranking.earliest(frame, "k", ["day", "id"], ["id", "x"])
    assert rows(got, "k", "id", "x") == [("a", "s2", "r"), ("b", "s9", None)]


@pytest.mark.parametrize("few", [3, 10**6])
@pytest.mark.parametrize("n", [0, 1, 3, 4, 10, 103])
def test_tiles_by_borders_equal_ntile(spark, tmp_path, n, few):
    frame = spark.range(n).select(F.format_string("p%03d", "id").alias("p"), F.when(F.col("id") % 5 != 1, F.col("id") % 3).alias("v"))
    for order in (("-v", "p"), ("v", "-p")):
        plain = frame.withColumn("q", F.ntile(4).over(Window.orderBy(*selection.Order(order).sort())))
        got = selection.tiles(frame, str(tmp_path / order[0]), selection.Order(order), 4, "q", few=few)
        assert rows(got, "p", "q") == rows(plain, "p", "q")


def test_borders_of_a_large_table_take_a_few_passes(spark, tmp_path, monkeypatch):
    """Most rows share one value; no task numbers more than a few of them."""
    monkeypatch.setattr(selection, "SAMPLE", 200)
    frame = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.xxhash64("id") % 900).alias("v"), F.xxhash64("id", F.lit(1)).alias("p"))
    order, table = selection.Order(("-v", "p")), str(tmp_path / "t")
    got = selection.tiles(frame, table, order, 10, "q", few=50)
    assert rows(got, "p", "q") == rows(frame.withColumn("q", F.ntile(10).over(Window.orderBy(*order.sort()))), "p", "q")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_equal_rows_end_the_search(spark, tmp_path):
    spark.createDataFrame([(1,)] * 30, "v int").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert selection.rows_at_ranks(stored, selection.Order(("v",)), [7, 20], 30, 5) == {7: (1,), 20: (1,)}


def test_global_positions_split_a_run_of_ties(spark):
    frame = spark.range(2000).select(F.format_string("%05d", "id").alias("p"), F.lit(0).alias("v"))
    got = ranking.global_positions(frame, [F.col("v").desc(), F.col("p").asc()], "pos", local_rows=0)
    assert [r.pos for r in got.orderBy("p").collect()] == list(range(1, 2001))


def test_upsert_updates_inserts_and_keeps(spark):
    target = spark.createDataFrame([(1, "old"), (2, "same")], "id int, v string")
    source = spark.createDataFrame([(1, "new"), (3, "added")], "id int, v string")
    once = merge.upsert(target, source, "id")
    assert rows(once) == [(1, "new"), (2, "same"), (3, "added")]
    assert rows(merge.upsert(once, source, "id")) == rows(once)


def test_upsert_grows_the_schema_and_drops_nothing(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, gone string")
    source = spark.createDataFrame([(2, 9)], "id int, extra int")
    got = merge.upsert(target, source, "id")
    assert got.columns == ["id", "gone", "extra"]
    assert rows(got) == [(1, "a", None), (2, "b", 9)]


def test_upsert_sets_a_value_to_null_and_adds_rows_without_a_key(spark):
    target = spark.createDataFrame([(1, "a", "x"), (None, "n", "y")], "id int, v string, kept string")
    source = spark.createDataFrame([(1, None, 5), (None, "m", 6), (3, "c", 7)], "id int, v string, new int")
    got = merge.upsert(target, source, "id")
    assert rows(got) == rows(
        spark.createDataFrame(
            [(1, None, "x", 5), (None, "n", "y", None), (None, "m", None, 6), (3, "c", None, 7)],
            "id int, v string, kept string, new int",
        )
    )


def test_upsert_rejects_repeated_keys(spark):
    source = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(ValueError, match="repeated"):
        merge.upsert(source, source, "id")


def test_trailing_sum_counts_missing_days_as_zero(spark):
    daily = spark.createDataFrame([("x", d("2024-01-01"), 5), ("x", d("2024-01-09"), 7), ("y", d("2024-01-03"), 1)], "k string, day date, v int")
    got = {(r.k, r.day): r.s for r in trailing.trailing_sum(daily, "day", "v", 7, ["k"], "s").collect()}
    assert len(got) == 18
    assert got["x", d("2024-01-07")] == 5 and got["x", d("2024-01-08")] == 0 and got["x", d("2024-01-09")] == 7
    assert got["y", d("2024-01-01")] == 0 and got["y", d("2024-01-09")] == 1


def test_random_rows(spark):
    frame = spark.range(500)
    a = [r.id for r in ranking.random_rows(frame, 20, seed=1).collect()]
    assert len(set(a)) == 20 and a != sorted(a)


def test_next_keys_continue_the_numbering(spark):
    table = spark.createDataFrame([("ORD_10007",), ("ORD_9",), ("bad",), (None,), ("X" + "9" * 40,)], "order_id string")
    assert sinks.highest_number(table, "order_id", 5).first()[0] == 10007
    long = spark.createDataFrame([("ORD_5",), ("ORD_" + "9" * 20,)], "order_id string")
    assert sinks.highest_number(long, "order_id", 5).first()[0] == 10**20 - 1
    assert sinks.highest_number(table.where("order_id = 'bad'"), "order_id", 5).first()[0] == 5
    batch = spark.createDataFrame([("b",), ("a",)], "n string")
    for local in (0, 100):
        got = sinks.with_next_keys(batch, table, "order_id", ["n"], "ORD_%06d", local_rows=local)
        assert rows(got, "n", "order_id") == [("a", "ORD_010008"), ("b", "ORD_010009")]


def test_sinks(spark, tmp_path):
    frame = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    stored = sinks.write_clustered(frame, str(tmp_path / "t"), "g", "k")
    assert stored.count() == 100
    at = dt.datetime(2024, 5, 1, 6)
    stamped = sinks.write_table(frame.withColumn("_loaded_at", F.lit(at)), str(tmp_path / "s"))
    grown = sinks.append_rows(frame.limit(5), str(tmp_path / "s"), dt.datetime(2024, 5, 2, 6))
    assert stamped.count() == 100
    assert {r[0]: r[1] for r in grown.groupBy("_loaded_at").count().collect()} == {at: 100, dt.datetime(2024, 5, 2, 6): 5}
    now = sinks.append_rows(frame.limit(3), str(tmp_path / "s")).agg(F.max("_loaded_at")).first()[0]
    assert now > dt.datetime(2024, 5, 2, 6)
