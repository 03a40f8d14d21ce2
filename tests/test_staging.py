"""Typed loading and the row-wise staging models, in batch and as a stream."""

import datetime as dt

import pytest

from conftest import by, d, m, rows
from shopledger.plans import staging as S
from shopledger.schemas import RAW_DDL, raw_schema
from shopledger.sources.raw import load_csv, load_parquet
from shopledger.streaming.staging import append_stream, staged_stream

SHIPMENTS = """shipment_id,order_id,carrier,tracking_number,estimated_delivery_date,shipped_at,delivered_at,shipment_status,_loaded_at
S1,O1,DHL,T1,2024-01-05,2024-01-02,2024-01-04,delivered,2024-06-01T00:00:00
S2,O2,UPS,T2,2024-01-05,,,in_transit,2024-06-01T00:00:00
"""
PRODUCTS = """product_id,product_name,category,subcategory,material,color,unit_price,cost_price,sku_code,collection,is_active,launched_at,_loaded_at
P1,Tote,Bags,Tote Bag,Suede,Tan,640.00,160.00,SKU1,Rivoli,TRUE,2020-02-29,2025-01-01T00:00:00
P2,Free,Bags,Tote Bag,Suede,Tan,0.00,1.00,SKU2,Rivoli,false,2021-03-15,2025-01-01T00:00:00
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.mkdir(exist_ok=True)
    (path / "part1.csv").write_text(text)
    return str(path)


def test_ten_raw_schemas(spark):
    assert len(RAW_DDL) == 10 and set(S.STAGING) == set(RAW_DDL)
    for table in RAW_DDL:
        assert raw_schema(table).fieldNames()[-1] == "_loaded_at"


def test_csv_is_typed_and_blank_is_null(spark, tmp_path):
    got = load_csv(spark, "raw_shipments", write(tmp_path, "s", SHIPMENTS))
    assert got.schema == raw_schema("raw_shipments")
    assert rows(got, "shipment_id", "shipped_at", "delivered_at") == [("S1", d("2024-01-02"), d("2024-01-04")), ("S2", None, None)]
    assert got.first()["_loaded_at"] == dt.datetime(2024, 6, 1)


def test_csv_with_a_bad_value_fails(spark, tmp_path):
    bad = SHIPMENTS.replace("2024-01-02", "soon")
    with pytest.raises(Exception, match="(?i)malformed|soon"):
        load_csv(spark, "raw_shipments", write(tmp_path, "bad", bad)).collect()


def test_a_bad_value_fails_the_stream_too(spark, tmp_path):
    bad = write(tmp_path, "bad", SHIPMENTS.replace("2024-01-02", "soon"))
    with pytest.raises(Exception, match="(?i)malformed|soon|terminated|failed"):
        append_stream(staged_stream(spark, "raw_shipments", bad), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()


def test_dates_of_text_columns_are_blank_or_valid(spark):
    def staged(text):
        columns = "return_id string, order_id string, order_item_id string, return_reason string, return_requested_at string, "
        columns += "return_received_at string, refund_amount string, refund_status string, _loaded_at timestamp_ntz"
        return S.stg_returns(spark.createDataFrame([("R", "O", "", "x", text, " ", "1.00", "pending", None)], columns)).first()

    assert staged("2024-02-29").return_requested_at == d("2024-02-29") and staged("").return_requested_at is None
    with pytest.raises(Exception, match="malformed date in return_requested_at: 31/12/2024"):
        staged("31/12/2024")


def test_products_from_csv(spark, tmp_path):
    got = by(S.stg_products(load_csv(spark, "raw_products", write(tmp_path, "p", PRODUCTS))), "product_id")
    assert got["P1"].gross_margin == m("480.00") and got["P1"].margin_pct == m("75.0000") and got["P1"].is_active
    assert got["P2"].margin_pct is None and got["P2"].is_active is False


def test_parquet_load(spark, tmp_path, raw):
    raw("raw_orders", {"order_id": "1"}).write.parquet(str(tmp_path / "o"))
    assert load_parquet(spark, "raw_orders", str(tmp_path / "o")).first().order_id == "1"


def test_customers(raw):
    got = S.stg_customers(raw("raw_customers", {"customer_id": "C", "email": "  Ann@Mail.COM "})).first()
    assert got.email == "ann@mail.com" and got.loaded_at == dt.datetime(2024, 6, 1, 6)


def test_orders_blank_code_and_missing_discount(raw):
    got = by(S.stg_orders(raw("raw_orders", {"order_id": "1", "discount_code": "", "discount_amount": None}, {"order_id": "2", "discount_code": "X", "discount_amount": m("5.00")})), "order_id")
    assert (got["1"].discount_code, got["1"].discount_amount) == (None, m("0.00"))
    assert (got["2"].discount_code, got["2"].discount_amount) == ("X", m("5.00"))


def test_items_revenue_with_and_without_discount(raw):
    item = {"quantity": m("3"), "unit_price_at_order": m("19.99")}
    got = by(S.stg_order_items(raw("raw_order_items", {"order_item_id": "1", **item}, {"order_item_id": "2", "discount_pct": m("15.00"), **item})), "order_item_id")
    assert got["1"].line_revenue == m("59.97") and got["1"].discount_pct == m("0.00")
    assert got["2"].line_revenue == m("50.97")


def test_payments_currency(raw):
    got = S.stg_payments(raw("raw_payments", {"payment_id": "1", "amount": m("10.05"), "currency": "gbp"})).first()
    assert got.amount_eur == m("11.76") and got.currency == "gbp"


def test_shipments_keep_raw_delivery_text(spark):
    frame = spark.createDataFrame(
        [("1", "2024-01-03"), ("2", ""), ("3", None)], "shipment_id string, delivered_at string"
    ).selectExpr(
        "shipment_id", "'o' order_id", "'c' carrier", "'t' tracking_number", "date '2024-01-01' estimated_delivery_date",
        "date '2024-01-01' shipped_at", "delivered_at", "'x' shipment_status", "timestamp_ntz '2024-01-01 00:00:00' _loaded_at",
    )
    got = S.stg_shipments(frame)
    assert rows(got, "shipment_id", "delivered_at_raw", "delivered_at") == [("1", "2024-01-03", d("2024-01-03")), ("2", None, None), ("3", None, None)]


def test_returns_campaigns_attributions(raw):
    assert S.stg_returns(raw("raw_returns", {"return_id": "1", "order_item_id": ""})).first().order_item_id is None
    campaign = S.stg_campaigns(raw("raw_campaigns", {"campaign_id": "1", "start_date": d("2024-01-01"), "end_date": d("2024-03-01")})).first()
    assert campaign.campaign_duration_days == 60
    assert S.stg_campaign_attributions(raw("raw_campaign_attributions", {"attribution_id": "1", "attributed_revenue_eur": m("1.50")})).first().attributed_revenue_eur == m("1.50")


def test_web_events(raw):
    at = dt.datetime(2024, 5, 5, 23, 59)
    got = by(S.stg_web_events(raw("raw_web_events", {"event_id": "1", "customer_id": "", "product_id": "", "utm_source": "", "event_timestamp": at}, {"event_id": "2", "customer_id": "C"})), "event_id")
    assert got["1"].customer_id is None and got["1"].product_id is None and got["1"].utm_source is None
    assert got["1"].is_authenticated is False and got["2"].is_authenticated is True
    assert got["1"].event_date == d("2024-05-05")


def test_staging_runs_on_a_stream(spark, tmp_path):
    source = write(tmp_path, "arriving", SHIPMENTS)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        append_stream(staged_stream(spark, "raw_shipments", source), out, state).awaitTermination()
        return rows(spark.read.parquet(out), "shipment_id", "delivered_at")

    assert drain() == [("S1", d("2024-01-04")), ("S2", None)]
    (tmp_path / "arriving" / "part2.csv").write_text(SHIPMENTS.replace("S1", "S3").replace("S2", "S4"))
    assert [r[0] for r in drain()] == ["S1", "S2", "S3", "S4"]  # earlier files are not read again
