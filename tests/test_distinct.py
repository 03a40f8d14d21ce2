"""Distinct counts from stored sets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import rows
from shopledger.operators.distinct import distinct_counts, distinct_state, key_numbers, merged_states

DDL = "who string, day date, place string"


def visits(n, seed, people=40_000):
    rng = random.Random(seed)
    return [
        (f"p{rng.randint(0, people)}" if rng.random() > 0.1 else None, dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 70)), rng.choice(["x", "y", None]))
        for _ in range(n)
    ]


def recounted(frame, by, grain):
    period = [F.trunc("day", "MM").alias("period")] if grain == "month" else []
    return rows(frame.groupBy(*by, *period).agg(F.count_distinct("who").alias("n")))


def test_numbers_are_dense_and_go_on(spark):
    first = spark.createDataFrame(visits(5000, 1), DDL).repartition(7)
    numbers = key_numbers(first, "who")
    n = numbers.count()
    assert sorted(r["number"] for r in numbers.collect()) == list(range(n)) and n == first.select("who").dropna().distinct().count()
    both = first.union(spark.createDataFrame(visits(3000, 2), DDL))
    more = key_numbers(both, "who", numbers)
    assert sorted(r["number"] for r in more.collect()) == list(range(both.select("who").dropna().distinct().count()))
    assert set(map(tuple, numbers.collect())) <= set(map(tuple, more.collect()))


def test_any_grouping_is_a_union_of_one_state(spark):
    old, new = (spark.createDataFrame(visits(6000, s), DDL) for s in (3, 4))
    old = old.union(spark.createDataFrame([(None, dt.date(2023, 5, 5), "only null")], DDL))
    numbers = key_numbers(old, "who")
    state = distinct_state(old, numbers, "who", "day", ["place"])
    numbers = key_numbers(new, "who", numbers)
    state = merged_states(state, distinct_state(new, numbers, "who", "day", ["place"]))
    both = old.union(new)
    for by in (["place"], []):
        for grain in ("month", None):
            assert rows(distinct_counts(state, by, grain, "n")) == recounted(both, by, grain)


def test_empty(spark):
    none = spark.createDataFrame([], DDL)
    numbers = key_numbers(none, "who")
    assert numbers.count() == 0
    assert distinct_counts(distinct_state(none, numbers, "who", "day", ["place"]), ["place"], "day", "n").count() == 0
    assert key_numbers(spark.createDataFrame(visits(10, 1), DDL), "who", numbers).agg(F.min("number")).first()[0] == 0


def test_the_state_of_unique_keys_has_a_few_bitmaps_for_each_set(spark):
    """Each day and shop has keys from all over; their numbers lie together all the same."""
    n, days, shops = 120_000, 10, 3
    frame = spark.range(n).selectExpr(
        "cast(id as string) as who", f"date_add(date '2024-01-01', cast(xxhash64(id) % {days} as int)) as day", f"xxhash64(id, 1) % {shops} as shop"
    )
    sets = frame.select("day", "shop").distinct().count()
    state = distinct_state(frame, key_numbers(frame, "who", near=["shop", "day"]), "who", "day", ["shop"])
    assert state.count() <= sets + -(-n // 32768)
    assert distinct_state(frame, key_numbers(frame, "who"), "who", "day", ["shop"]).count() > 2 * sets
    got = {(r["shop"], r["period"]): r["n"] for r in distinct_counts(state, ["shop"], "day", "n").collect()}
    assert got == {(r[0], r[1]): r[2] for r in frame.groupBy("shop", "day").count().collect()}


def test_near_numbers_go_on_from_known_ones_and_skip_null_keys(spark):
    first = spark.createDataFrame(visits(200, 3), DDL)
    both = first.unionByName(spark.createDataFrame(visits(200, 4), DDL))
    known = key_numbers(first, "who", near=["day"])
    again = key_numbers(both, "who", known, near=["day"])
    numbers = sorted(r["number"] for r in again.collect())
    assert numbers == list(range(both.where("who is not null").select("who").distinct().count()))
    assert known.exceptAll(again).isEmpty()
