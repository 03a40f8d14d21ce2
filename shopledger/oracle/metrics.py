"""One SQL statement per registered metric query."""

from __future__ import annotations

from .blocks import avg_of

METRIC_FINALS = {
    "j01_total_customers": """
select country, loyalty_tier, count(distinct customer_id) total_customers from d_customers group by all""",
    "j02_avg_ltv": f"""
select acquisition_channel, date_trunc('quarter', signup_date)::date period, {avg_of("lifetime_value_eur")} avg_ltv
from d_customers group by all""",
    "j03_total_products": """
select category, performance_tier, count(distinct product_id) total_products from d_products group by all""",
    "j04_avg_product_margin": f"""
select category, date_trunc('month', launched_at)::date period, {avg_of("margin_pct")} avg_product_margin
from d_products group by all""",
    "j05_total_revenue": """
select channel, date_trunc('month', order_date)::date period, sum(net)::double total_revenue from b_orders group by all""",
    "j06_total_gross_revenue": """
select date_trunc('quarter', order_date)::date period, sum(gross)::double total_gross_revenue from b_orders group by all""",
    "j07_total_orders": """
select shipping_country, date_trunc('year', order_date)::date period, count(distinct order_id) total_orders
from b_orders group by all""",
    "j08_average_order_value": f"""
select channel, date_trunc('month', order_date)::date period, {avg_of("net")} average_order_value from b_orders group by all""",
    "j09_total_discount_amount": """
select (order_date - (isodow(order_date) - 1)::int)::date period, sum(discount_amount)::double total_discount_amount
from b_orders group by all""",
    "j10_new_customer_orders": """
select date_trunc('month', order_date)::date period, count(distinct order_id) filter (where is_first) new_customer_orders
from b_orders group by all""",
    "j11_returned_order_count": """
select channel, order_status, count(distinct order_id) filter (where sent_back) returned_order_count
from b_orders group by all""",
    "j12_late_delivery_orders": """
select carrier, date_trunc('year', order_date)::date period,
       count(distinct order_id) filter (where is_late_delivery) late_delivery_orders
from f_orders group by all""",
    "j13_avg_days_to_ship": f"""
select shipping_method, {avg_of("days_to_ship")} avg_days_to_ship from f_orders group by all""",
    "j14_discount_rate": """
select date_trunc('month', order_date)::date period,
       sum(discount_amount)::double / nullif(sum(gross)::double, 0) discount_rate
from b_orders where order_status <> 'cancelled' group by all""",
    "j15_late_delivery_rate": """
select channel, loyalty_tier customer__loyalty_tier, country customer__country,
       count(*) filter (where is_late_delivery)::double / count(*) late_delivery_rate
from f_orders join s_customers using (customer_id) group by all""",
    "j16_revenue_last_7_days": """
with days as (select unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day))::date t from orders)
select t period, coalesce((select sum(net) from b_orders where order_date between t - 6 and t), 0)::double revenue_last_7_days
from days""",
    "j17_revenue_last_30_days": """
with days as (select unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day))::date t from orders),
starts as (select date_trunc('month', t)::date period, min(t) t from days group by 1)
select channel, period, coalesce(sum(net) filter (where order_date between t - 29 and t), 0)::double revenue_last_30_days
from starts cross join b_orders group by all""",
}
