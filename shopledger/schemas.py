"""Declared schemas of the raw tables, contracts of the core marts, and value domains."""

from __future__ import annotations

from pyspark.sql import types as T


# Raw tables: fixed column names and types of the input files.
RAW_DDL = {
    "raw_customers": (
        "customer_id string, first_name string, last_name string, email string, phone string, "
        "birth_date date, gender string, city string, country string, signup_date date, "
        "loyalty_tier string, acquisition_channel string, _loaded_at timestamp_ntz"
    ),
    "raw_products": (
        "product_id string, product_name string, category string, subcategory string, material string, "
        "color string, unit_price decimal(10,2), cost_price decimal(10,2), sku_code string, "
        "collection string, is_active boolean, launched_at date, _loaded_at timestamp_ntz"
    ),
    "raw_orders": (
        "order_id string, customer_id string, order_date date, order_status string, channel string, "
        "shipping_city string, shipping_country string, shipping_method string, discount_code string, "
        "discount_amount decimal(10,2), _loaded_at timestamp_ntz"
    ),
    "raw_order_items": (
        "order_item_id string, order_id string, product_id string, quantity decimal(5,0), "
        "unit_price_at_order decimal(10,2), discount_pct decimal(5,2), _loaded_at timestamp_ntz"
    ),
    "raw_payments": (
        "payment_id string, order_id string, payment_date date, payment_method string, "
        "amount decimal(10,2), currency string, payment_status string, gateway string, "
        "_loaded_at timestamp_ntz"
    ),
    "raw_shipments": (
        "shipment_id string, order_id string, carrier string, tracking_number string, "
        "estimated_delivery_date date, shipped_at date, delivered_at date, shipment_status string, "
        "_loaded_at timestamp_ntz"
    ),
    "raw_returns": (
        "return_id string, order_id string, order_item_id string, return_reason string, "
        "return_requested_at date, return_received_at date, refund_amount decimal(10,2), "
        "refund_status string, _loaded_at timestamp_ntz"
    ),
    "raw_campaigns": (
        "campaign_id string, campaign_name string, campaign_type string, channel string, "
        "start_date date, end_date date, budget_eur decimal(12,2), target_segment string, "
        "utm_source string, utm_medium string, utm_campaign string, _loaded_at timestamp_ntz"
    ),
    "raw_campaign_attributions": (
        "attribution_id string, customer_id string, campaign_id string, order_id string, "
        "first_touch_campaign_id string, last_touch_campaign_id string, "
        "attributed_revenue_eur decimal(10,2), attribution_model string, _loaded_at timestamp_ntz"
    ),
    "raw_web_events": (
        "event_id string, session_id string, customer_id string, event_type string, "
        "event_timestamp timestamp_ntz, page_url string, product_id string, device_type string, "
        "browser string, utm_source string, _loaded_at timestamp_ntz"
    ),
}

# Published core marts: exact column set, order and types. Counts are bigint, money is
# decimal(18,2), averages are double.
CONTRACT_DDL = {
    "dim_customers": (
        "customer_id string, first_name string, last_name string, full_name string, email string, "
        "city string, country string, birth_date date, age int, gender string, signup_date date, "
        "loyalty_tier string, acquisition_channel string, total_orders bigint, "
        "lifetime_value_eur decimal(18,2), avg_order_value_eur double, first_order_date date, "
        "last_order_date date, days_since_last_order int, customer_tenure_days int, "
        "favorite_category string, total_items_returned bigint, customer_status string"
    ),
    "dim_products": (
        "product_id string, product_name string, category string, subcategory string, material string, "
        "color string, current_price decimal(10,2), cost_price decimal(10,2), margin_pct decimal(10,4), "
        "sku_code string, collection string, is_active boolean, launched_at date, total_orders bigint, "
        "total_units_sold bigint, total_revenue decimal(18,2), return_rate decimal(10,4), "
        "avg_days_to_return decimal(10,2), first_sold_date date, last_sold_date date, "
        "performance_tier string"
    ),
    "dim_date": (
        "date_day date, date_key int, day_of_week int, day_name string, month_num int, "
        "month_name string, quarter int, year int, is_weekend boolean, is_weekday boolean, "
        "week_of_year int, day_of_year int, is_first_day_of_month boolean, "
        "is_last_day_of_month boolean, fiscal_quarter string, fiscal_year int, season string, "
        "year_month string, year_str string"
    ),
    "fct_orders": (
        "order_id string, customer_id string, order_date date, order_date_key int, channel string, "
        "order_status string, shipping_country string, shipping_method string, discount_code string, "
        "item_count bigint, total_quantity bigint, gross_revenue_eur decimal(18,2), "
        "discount_amount_eur decimal(18,2), net_revenue_eur decimal(18,2), product_categories string, "
        "has_returned boolean, is_first_order boolean, payment_method string, payment_status string, "
        "total_paid_eur decimal(18,2), is_refunded boolean, carrier string, shipment_status string, "
        "days_to_ship int, days_to_deliver int, is_late_delivery boolean"
    ),
    "fct_order_items": (
        "order_item_id string, order_id string, product_id string, customer_id string, order_date date, "
        "order_status string, quantity bigint, unit_price_eur decimal(10,2), discount_pct decimal(5,2), "
        "line_revenue_eur decimal(18,2), has_been_returned boolean"
    ),
    "fct_payments": (
        "payment_id string, order_id string, customer_id string, payment_date date, order_date date, "
        "payment_method string, gateway string, currency string, amount_original decimal(10,2), "
        "amount_eur decimal(18,2), payment_status string, is_refunded boolean, days_to_payment int"
    ),
}


def raw_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(RAW_DDL[table])


def contract(mart: str) -> T.StructType:
    return T.StructType.fromDDL(CONTRACT_DDL[mart])


# Accepted values per column.
DOMAINS = {
    "gender": ["M", "F", "Other"],
    "loyalty_tier": ["Bronze", "Silver", "Gold", "Platinum"],
    "acquisition_channel": ["website", "mobile_app", "in_store", "wholesale", "referral"],
    "customer_status": ["prospect", "active", "at_risk", "churned"],
    "category": ["Bags", "Wallets", "Belts", "Accessories", "Shoes"],
    "collection": ["Haussmann", "Rivoli", "Marais", "Vendome", "Bastille", "Classique"],
    "performance_tier": ["hero", "core", "niche", "long_tail", "unranked"],
    "order_status": ["pending", "confirmed", "processing", "shipped", "delivered", "cancelled", "returned"],
    "payment_status": ["completed", "failed", "refunded", "pending"],
    "material": ["Full Grain Leather", "Genuine Leather", "Suede", "Canvas", "Patent Leather"],
    "shipment_status": ["delivered", "in_transit", "failed", "returned_to_sender"],
    "refund_status": ["pending", "approved", "completed", "rejected"],
    "event_type": [
        "page_view", "product_view", "add_to_cart", "remove_from_cart",
        "checkout_start", "checkout_complete", "search",
    ],
    "device_type": ["desktop", "mobile", "tablet"],
}

# Columns that hold personal data. Union of the table-level and column-level tags.
PII_COLUMNS = {
    "raw_customers": ["email", "first_name", "last_name", "phone", "birth_date"],
    "stg_customers": ["email", "first_name", "last_name", "phone", "birth_date"],
    "dim_customers": ["email", "first_name", "last_name", "full_name", "birth_date"],
}

# Orders in these states carry no revenue in the consumer marts.
NOT_KEPT = ("cancelled", "pending")
