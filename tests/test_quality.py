"""Declared rules, freshness, contracts, personal data."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import LOADED, rows
from shopledger import quality as Q
from shopledger.schemas import CONTRACT_DDL, DOMAINS, contract


def test_all_declared_rules_are_present():
    assert Counter(r.kind for r in Q.RULES) == {"unique": 49, "not_null": 93, "accepted_values": 26}
    assert {r.column for r in Q.RULES if r.kind == "accepted_values"} <= set(DOMAINS)
    layers = Counter((r.layer, r.kind) for r in Q.RULES)
    assert layers["seed", "not_null"] == 17 and layers["source", "accepted_values"] == 5
    assert layers["staging", "not_null"] == 25 and layers["core", "accepted_values"] == 9


def test_contract_columns(spark):
    assert {t: len(contract(t)) for t in CONTRACT_DDL} == {
        "dim_customers": 23, "dim_products": 21, "dim_date": 19, "fct_orders": 26, "fct_order_items": 11, "fct_payments": 13,
    }


def test_check_counts_failures(spark):
    frame = spark.createDataFrame(
        [("1", "M"), ("1", "F"), ("2", "X"), (None, None), (None, "x")], "customer_id string, gender string"
    )
    rules = [Q.Rule("t", "c", "customer_id", "unique"), Q.Rule("t", "c", "customer_id", "not_null"), Q.Rule("t", "c", "gender", "accepted_values")]
    got = {r.rule: r.failures for r in Q.check(frame, rules).collect()}
    assert got == {"unique": 1, "not_null": 2, "accepted_values": 2}  # NULL passes accepted values


def test_the_rules_of_a_table_share_one_pass(spark):
    """The first unique rule does not compute its table a second time; a table without rows has no failures."""
    frame = spark.createDataFrame([("1", "M", "a"), ("1", "X", "b"), (None, "X", "b"), (None, "x", "b")], "customer_id string, gender string, email string")
    rules = [Q.Rule("t", "c", "customer_id", "unique"), Q.Rule("t", "c", "customer_id", "not_null"), Q.Rule("t", "c", "gender", "accepted_values")]
    checked = Q.check(frame, rules)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert rows(checked, "rule", "failures") == [("accepted_values", 3), ("not_null", 2), ("unique", 1)]
    assert rows(Q.check(frame.where("false"), rules), "failures") == [(0,)] * 3
    both = Q.check(frame, [*rules, Q.Rule("t", "c", "email", "unique")])
    assert rows(both, "column_name", "rule", "failures") == [
        ("customer_id", "not_null", 2), ("customer_id", "unique", 1), ("email", "unique", 1), ("gender", "accepted_values", 3),
    ]


def test_rules_are_counted_by_the_write(spark, tmp_path):
    data = [(f"k{i // 2 if i < 40 else i}", i % 9 and "M" or "odd", i) for i in range(300)] + [(None, "F", 1), (None, None, 2)]
    frame = spark.createDataFrame(data, "customer_id string, gender string, n int").repartition(5)
    rules = [Q.Rule("t", "c", "customer_id", "unique"), Q.Rule("t", "c", "customer_id", "not_null"), Q.Rule("t", "c", "gender", "accepted_values")]
    log = Q.RuleLog()
    for i, cluster in enumerate([(), ("n",)]):
        stored = log.write(frame, rules, str(tmp_path / str(i)), cluster)
        assert rows(stored) == rows(frame)
    want = rows(Q.check(frame, rules))
    assert rows(log.report(spark)) == sorted(want * 2) and log.failures("unique") == {"c.customer_id": 20}


def test_row_rules_share_one_pass(spark):
    frame = spark.createDataFrame([("a", "b", "c")], "order_id string, customer_id string, order_status string")
    plan = Q.check(frame, Q.rules_of("fct_orders", kinds=["not_null", "accepted_values"])[0:2])._jdf.queryExecution().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") > 0
    assert "Union" not in plan


@pytest.mark.parametrize("hours, state", [(24, "pass"), (25, "warn"), (48, "warn"), (49, "error")])
def test_freshness_limits(raw, hours, state):
    got = Q.freshness({"raw_orders": raw("raw_orders", {"order_id": "1"})}, LOADED + dt.timedelta(hours=hours)).first()
    assert (got.state, got.age_hours, got.last_loaded_at) == (state, hours, LOADED)


def test_freshness_just_over_the_limit_and_without_rows(raw):
    frame = raw("raw_orders", {"order_id": "1"})
    assert Q.freshness({"x": frame}, LOADED + dt.timedelta(hours=24, seconds=1)).first().state == "warn"
    assert Q.freshness({"x": frame.where("false")}, LOADED).first().state == "error"


def test_contract_enforcement(spark):
    good = spark.createDataFrame([], contract("fct_payments"))
    assert Q.enforce_contract(good.select(*reversed(good.columns)), "fct_payments").schema == contract("fct_payments")
    broken = good.drop("currency").withColumn("note", F.lit("x")).withColumn("days_to_payment", F.lit("3"))
    problems = Q.contract_problems(broken.schema, contract("fct_payments"))
    assert sorted(problems) == [("currency", "missing"), ("days_to_payment", "mistyped"), ("note", "extra")]
    with pytest.raises(Q.ContractError):
        Q.enforce_contract(broken, "fct_payments")
    report = Q.contract_report({"fct_payments": broken}).first()
    assert (report.missing, report.extra, report.mistyped, report.row_count) == (1, 1, 1, 0)


def test_redaction(raw):
    frame = raw("raw_customers", {"customer_id": "1", "first_name": "Ann", "email": "a@x", "city": "Nice"})
    tagged = Q.tag_personal(frame, "raw_customers")
    assert tagged.schema["email"].metadata == {"pii": True} and tagged.schema["city"].metadata == {}
    got = Q.redact(tagged, "raw_customers").first().asDict()
    assert got["first_name"] != "Ann" and len(got["first_name"]) == 64 and got["city"] == "Nice"
    assert "birth_date" not in got and got["last_name"] is None
    also = Q.redact(frame.withMetadata("city", {"pii": True}), "other").first()
    assert len(also.city) == 64 and also.first_name == "Ann"  # the tag alone is enough


def test_orphans(spark):
    child = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "k string")
    parent = spark.createDataFrame([("1",)], "k string")
    assert rows(Q.orphans(child, parent, "k")) == [("2", 2)]
