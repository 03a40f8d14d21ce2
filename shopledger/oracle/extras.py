"""SQL statements of the registered operator and data-rule queries."""

from __future__ import annotations

from .models import FINALS

# Registered name of a staging table -> SQL block or statement with its columns.
STAGED = {
    "stg_customers": "select * from s_customers",
    "stg_products": "select * from s_products",
    "stg_orders": "select * from s_orders",
    "stg_order_items": "select * from s_items",
    "stg_payments": "select * from s_payments",
    "stg_shipments": "select * from s_shipments",
    "stg_returns": "select * from s_returns",
    "stg_campaigns": FINALS["m08_stg_campaigns"],
    "stg_campaign_attributions": FINALS["m09_stg_campaign_attributions"],
    "stg_web_events": FINALS["m10_stg_web_events"],
    "dim_customers": "select * from d_customers",
    "fct_orders": "select * from f_orders",
}
# Every other mart is the statement of its model.
MODEL_SQL = {key.split("_", 1)[1]: sql for key, sql in FINALS.items()}

# The rules as these statements know them, layer by layer: columns that must be unique, filled, or in a
# list of values.
UNIQUE = {
    "seed": "raw_customers.customer_id raw_products.product_id raw_orders.order_id raw_order_items.order_item_id raw_payments.payment_id "
    "raw_shipments.shipment_id raw_returns.return_id raw_campaigns.campaign_id raw_campaign_attributions.attribution_id raw_web_events.event_id",
    "staging": "stg_customers.customer_id stg_customers.email stg_products.product_id stg_orders.order_id stg_order_items.order_item_id "
    "stg_payments.payment_id stg_shipments.shipment_id stg_returns.return_id stg_campaigns.campaign_id "
    "stg_campaign_attributions.attribution_id stg_web_events.event_id",
    "core": "dim_customers.customer_id dim_products.product_id dim_date.date_day fct_orders.order_id fct_order_items.order_item_id fct_payments.payment_id",
    "finance": "fct_refunds.payment_id monthly_revenue_summary.year_month daily_flash_report.date_day country_revenue_breakdown.country",
    "marketing": "customer_segments.customer_id customer_ltv.customer_id channel_attribution.channel",
    "features": "customer_features.customer_id product_affinity_features.product_id order_sequence_features.order_id",
    "prep": "churn_prediction_input.customer_id customer_lifetime_value_features.customer_id",
}
FILLED = {
    "seed": UNIQUE["seed"] + " raw_customers.email raw_orders.customer_id raw_order_items.order_id raw_order_items.product_id "
    "raw_payments.order_id raw_shipments.order_id raw_returns.order_id",
    "staging": "stg_customers.customer_id stg_customers.first_name stg_customers.last_name stg_customers.email stg_customers.signup_date "
    "stg_products.product_id stg_products.product_name stg_products.unit_price stg_orders.order_id stg_orders.customer_id "
    "stg_orders.order_date stg_order_items.order_item_id stg_order_items.order_id stg_order_items.product_id stg_payments.payment_id "
    "stg_payments.order_id stg_shipments.shipment_id stg_shipments.order_id stg_returns.return_id stg_returns.order_id "
    "stg_campaigns.campaign_id stg_campaign_attributions.attribution_id stg_web_events.event_id stg_web_events.session_id "
    "stg_web_events.event_timestamp",
    "core": "dim_customers.customer_id dim_customers.signup_date dim_products.product_id dim_products.product_name dim_date.date_day "
    "fct_orders.order_id fct_orders.customer_id fct_orders.order_date fct_order_items.order_item_id fct_order_items.order_id "
    "fct_order_items.product_id fct_order_items.customer_id fct_payments.payment_id fct_payments.order_id",
    "finance": UNIQUE["finance"] + " fct_revenue.date_day product_margin_analysis.category",
    "marketing": UNIQUE["marketing"] + " cohort_analysis.signup_cohort_month cohort_analysis.order_cohort_month",
    "features": UNIQUE["features"] + " order_sequence_features.customer_id",
    "prep": UNIQUE["prep"] + " recommendation_input.customer_id recommendation_input.product_id",
}
UNIQUE["source"], FILLED["source"] = UNIQUE["seed"], FILLED["seed"] + " raw_products.unit_price"
# Accepted values.
_GENDERS = "('M', 'F', 'Other')"
_TIERS = "('Bronze', 'Silver', 'Gold', 'Platinum')"
_ACQUIRED = "('website', 'mobile_app', 'in_store', 'wholesale', 'referral')"
_CATEGORIES = "('Bags', 'Wallets', 'Belts', 'Accessories', 'Shoes')"
_ORDERED = "('pending', 'confirmed', 'processing', 'shipped', 'delivered', 'cancelled', 'returned')"
_PAID = "('completed', 'failed', 'refunded', 'pending')"
_COLLECTIONS = "('Haussmann', 'Rivoli', 'Marais', 'Vendome', 'Bastille', 'Classique')"
LISTED = {
    "source": {
        "raw_customers.loyalty_tier": _TIERS, "raw_customers.acquisition_channel": _ACQUIRED, "raw_products.category": _CATEGORIES,
        "raw_orders.order_status": _ORDERED, "raw_payments.payment_status": _PAID,
    },
    "staging": {
        "stg_customers.gender": _GENDERS, "stg_customers.loyalty_tier": _TIERS, "stg_customers.acquisition_channel": _ACQUIRED,
        "stg_products.category": _CATEGORIES, "stg_products.collection": _COLLECTIONS,
        "stg_products.material": "('Full Grain Leather', 'Genuine Leather', 'Suede', 'Canvas', 'Patent Leather')",
        "stg_orders.order_status": _ORDERED, "stg_payments.payment_status": _PAID,
        "stg_shipments.shipment_status": "('delivered', 'in_transit', 'failed', 'returned_to_sender')",
        "stg_returns.refund_status": "('pending', 'approved', 'completed', 'rejected')",
        "stg_web_events.event_type": "('page_view', 'product_view', 'add_to_cart', 'remove_from_cart', 'checkout_start', 'checkout_complete', 'search')",
        "stg_web_events.device_type": "('desktop', 'mobile', 'tablet')",
    },
    "core": {
        "dim_customers.gender": _GENDERS, "dim_customers.loyalty_tier": _TIERS, "dim_customers.acquisition_channel": _ACQUIRED,
        "dim_customers.customer_status": "('prospect', 'active', 'at_risk', 'churned')", "dim_products.category": _CATEGORIES,
        "dim_products.collection": _COLLECTIONS, "dim_products.performance_tier": "('hero', 'core', 'niche', 'long_tail', 'unranked')",
        "fct_orders.order_status": _ORDERED, "fct_payments.payment_status": _PAID,
    },
}


def rule_query(layer: str, kinds: tuple = ("unique", "not_null", "accepted_values"), tables: tuple = ()) -> str:
    """Failures of each rule of a layer, by a count of its own."""
    parts = []

    def add(place: str, kind: str, count) -> None:
        table, column = place.split(".")
        if kind in kinds and (not tables or table in tables):
            name = table.replace("raw_", "stg_") if layer in ("seed", "source") else table
            source = f"({STAGED.get(name) or MODEL_SQL[name]})"
            parts.append(f"select '{layer}' layer, '{table}' table_name, '{column}' column_name, '{kind}' rule, ({count(column, source)}) failures")

    for place in UNIQUE[layer].split():
        add(place, "unique", lambda c, t: f"select count(*) from (select 1 from {t} where {c} is not null group by {c} having count(*) > 1)")
    for place in FILLED[layer].split():
        add(place, "not_null", lambda c, t: f"select count(*) from {t} where {c} is null")
    for place, values in LISTED.get(layer, {}).items():
        add(place, "accepted_values", lambda c, t, v=values: f"select count(*) from {t} where {c} not in {v}")
    return "\nunion all ".join(parts)


# Latest load per raw table.
LOADS = {
    "raw_campaign_attributions": "select max(o_orderdate) from orders",
    "raw_campaigns": "select max(date '1995-01-01' + (s_suppkey * 11 % 2000)::int)::timestamp from supplier",
    "raw_customers": "select max(date '1994-10-01' + (c_custkey % 900)::int)::timestamp from customer",
    "raw_order_items": "select max(l_shipdate) from lineitem",
    "raw_orders": "select max(o_orderdate) from orders",
    "raw_payments": "select max(o_orderdate) from orders",
    "raw_products": "select max(date '1994-01-01' + (p_partkey % 365)::int)::timestamp from part",
    "raw_returns": "select max(l_shipdate) from lineitem where l_returnflag = 'R'",
    "raw_shipments": "select max(l_shipdate) from lineitem",
    "raw_web_events": "select max(ts) from events",
}
_loads = " union all ".join(f"select '{t}' source_name, ({q}) last_loaded_at" for t, q in LOADS.items())



def appended(model: str, key: str, prefix: str, width: int, changed: str = "") -> str:
    """Staged rows of a table, and all of them again under keys that go on from the highest number."""
    source = f"(select * exclude (loaded_at) from ({FINALS[model]}))"
    last = f"(select max(regexp_replace({key}, '[^0-9]', '', 'g')::hugeint) from {source})"
    digits = f"({last} + row_number() over (order by {key}))::varchar"
    number = f"if(length({digits}) < {width}, lpad({digits}, {width}, '0'), {digits})" if width else digits
    return f"""
select *, false is_new from {source}
union all
select * replace ('{prefix}' || {number} as {key}{', ' + changed if changed else ''}), true from {source}"""


EXTRA_FINALS = {
    "a01_typed_csv_load": FINALS["m03_stg_orders"],
    "a04_full_refresh": FINALS["m20_fct_order_items"],
    "a06_merge_orders": """
select order_id, customer_id, order_date, if(order_id::bigint % 3 = 1, 'processing', order_status) order_status,
       if(order_id::bigint % 3 = 0, null, net::double) net_revenue_eur, if(order_id::bigint % 3 = 1, null, channel) channel
from b_orders""",
    "a06_merge_one_month": """
with b as (select *, order_id::bigint n, strftime(order_date, '%Y%m') = '199803' fresh from b_orders)
select order_id, customer_id, if(fresh and n % 7 = 0, order_date + 40, order_date)::date order_date,
       if(fresh, order_status, 'processing') order_status, if(n % 3 = 0, null, net::double) net_revenue_eur, if(fresh, channel, null) channel
from b where fresh or n % 3 <> 0""",
    "a06_refresh_orders": FINALS["m19_fct_orders"],
    "a07_merge_new_columns": """
select order_id, net::double net_revenue_eur, if(order_id::bigint % 3 = 0, null, order_date) order_date,
       if(order_id::bigint % 3 = 1, null, channel) channel, if(order_id::bigint % 3 = 1, null, item_count) item_count
from b_orders""",
    "a08_clustered_table": FINALS["m11_int_orders_enriched"],
    "a08_along_curve": FINALS["m11_int_orders_enriched"],
    "a11_orders_in_buckets": """
select order_id, customer_id, order_date, order_status, item_count, gross::double gross_revenue, net::double net_revenue, p.payment_status,
       p.total_paid_eur::double total_paid_eur, p.is_refunded, carrier, shipment_status, days_to_deliver, is_late_delivery
from b_orders left join b_paid p using (order_id) left join b_shipped using (order_id)""",
    "a09_append_batch": appended("m03_stg_orders", "order_id", "ORD_", 0, "date '2001-08-01' as order_date"),
    "a09_append_items": appended("m04_stg_order_items", "order_item_id", "ITEM_", 6),
    "a09_append_payments": appended("m05_stg_payments", "payment_id", "PAY_", 6, "date '2001-08-01' as payment_date"),
    "a13_next_keys": """
select order_id was, customer_id,
       'ORD_' || (90000000000000000000::hugeint + (select max(o_orderkey) from orders) + row_number() over (order by order_id))::varchar order_id
from s_orders""",
    "a13_next_keys_from_footers": """
with n as (select *, (select max(o_orderkey) from orders) + row_number() over (order by order_id) k from s_orders)
select order_id was, customer_id, 'ORD_' || if(k < 1000000, lpad(k::varchar, 6, '0'), k::varchar) order_id from n""",
    "c02_spread_left_join": """
select order_id, customer_id, order_status, email, loyalty_tier
from s_orders left join s_customers using (customer_id)""",
    "c05_co_purchase_wide_baskets": FINALS["m35_product_affinity_features"],
    "e04_sequence_of_heavy_customers": FINALS["m34_order_sequence_features"],
    "e05_sequence_continued": FINALS["m34_order_sequence_features"],
    "e08_ntile_by_borders": """
select product_id, unit_price::double unit_price, ntile(4) over o quartile, ntile(7) over o seventh
from s_products window o as (order by unit_price desc, product_id)""",
    "f03_random_sample": """
select least(100, count(*)) as "rows", least(100, count(*)) customers, least(100, count(*)) known, true differs from customer""",
    "i01_unique": rule_query("staging", ("unique",)),
    "i02_not_null": rule_query("staging", ("not_null",)),
    "i03_accepted_values": rule_query("staging", ("accepted_values",)),
    "i04_one_pass_core": rule_query("core", tables=("dim_customers", "fct_orders")),
    "i05_source_freshness": f"""
select source_name, last_loaded_at, trunc(epoch(timestamp '2001-08-02 12:00:00' - last_loaded_at) / 3600)::bigint age_hours,
       case when last_loaded_at >= timestamp '2001-08-01 12:00:00' then 'pass'
            when last_loaded_at >= timestamp '2001-07-31 12:00:00' then 'warn' else 'error' end state
from ({_loads})""",
    "i06_contract_report": """
select m mart, 0 missing, 0 extra, 0 mistyped, n row_count
from (select 'dim_customers' m, count(*) n from customer union all select 'dim_products', count(*) from part
      union all select 'fct_orders', count(*) from orders
      union all select 'fct_order_items', count(*) from lineitem where l_orderkey in (select o_orderkey from orders)
      union all select 'fct_payments', count(*) + count(*) filter (where o_orderkey % 10 = 0) from orders
      union all select 'dim_date', count(*) from (""" + FINALS["m13_dim_date"] + """))
union all
select 'altered fct_payments', 1, 1, 1, count(*) + count(*) filter (where o_orderkey % 10 = 0) from orders""",
    "i07_redacted_customers": """
select customer_id, sha256(first_name) first_name, sha256(last_name) last_name, sha256(email) email, sha256(phone) phone,
       gender, city, country, signup_date, loyalty_tier, acquisition_channel
from s_customers""",
    "i08_unknown_products": """
select product_id, count(*) as "rows" from s_items
where product_id not in (select product_id from s_products where unit_price >= 1000) group by 1""",
}


def by_grains(source: str, key: str, day: str, by: str, name: str, grains=("day", "month", "year")) -> str:
    """Distinct keys counted anew for each grain."""
    parts = [
        f"select {by + ', ' if by else ''}date_trunc('{g}', {day})::date period, count(distinct {key}) {name}, '{g}' grain from {source} group by all"
        for g in grains
    ]
    return "\nunion all ".join(parts)


_GRAINS = ("week", "month", "quarter", "year")
EXTRA_FINALS |= {
    "d03_j01_customers_by_grain": by_grains("d_customers", "customer_id", "signup_date", "country, loyalty_tier", "total_customers"),
    "d03_j03_products_by_grain": by_grains("d_products", "product_id", "launched_at", "category, performance_tier", "total_products"),
    "d03_j07_orders_by_grain": by_grains("s_orders", "order_id", "order_date", "shipping_country", "total_orders"),
    "d03_active_customers": by_grains("s_orders", "customer_id", "order_date", "channel", "customers", _GRAINS)
    + "\nunion all by name\n"
    + by_grains("s_orders", "customer_id", "order_date", "'all' channel", "customers", _GRAINS),
}
EXTRA_FINALS |= {f"i04_rules_{layer}": rule_query(layer) for layer in UNIQUE if layer != "staging"}
EXTRA_FINALS["i05_freshness_from_footers"] = EXTRA_FINALS["i05_source_freshness"]
EXTRA_FINALS["i04_rules_while_writing"] = EXTRA_FINALS["i04_rules_core"]
# Every raw table through CSV files and the declared schema.
EXTRA_FINALS |= {f"a01_csv_{key.split('_stg_')[1]}": FINALS[key] for key in FINALS if "_stg_" in key}
