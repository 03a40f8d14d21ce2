"""One SQL statement per model. Money is cast to double in the last projection only."""

from __future__ import annotations

from .blocks import TODAY, avg_of, pct, pick, rate

FINALS: dict[str, str] = {}

# ---------------------------------------------------------------- staging
FINALS["m01_stg_customers"] = """
select *, signup_date::timestamp loaded_at from s_customers
"""
FINALS["m02_stg_products"] = """
select * replace (unit_price::double as unit_price, cost_price::double as cost_price, gross_margin::double as gross_margin,
                  margin_pct::double as margin_pct), launched_at::timestamp loaded_at from s_products
"""
FINALS["m03_stg_orders"] = """
select * replace (discount_amount::double as discount_amount), order_date::timestamp loaded_at from s_orders
"""
FINALS["m04_stg_order_items"] = """
select * replace (quantity::double as quantity, unit_price_at_order::double as unit_price_at_order,
                  discount_pct::double as discount_pct, line_revenue::double as line_revenue)
from s_items
"""
FINALS["m05_stg_payments"] = """
select p.* replace (amount::double as amount, amount_eur::double as amount_eur), o.order_date::timestamp loaded_at
from s_payments p join s_orders o using (order_id)
"""
FINALS["m06_stg_shipments"] = """
select *, delivered_at::varchar delivered_at_raw from s_shipments
"""
FINALS["m07_stg_returns"] = """
select * replace (refund_amount::double as refund_amount), (return_requested_at - 5)::timestamp loaded_at from s_returns
"""
FINALS["m08_stg_campaigns"] = f"""
select 'CAMP_' || s_suppkey campaign_id, s_name campaign_name, {pick(["awareness", "acquisition", "retention"], "s_suppkey")} campaign_type,
       {pick(["email", "instagram", "search"], "s_suppkey")} channel,
       (date '1995-01-01' + (s_suppkey * 11 % 2000)::int)::date start_date,
       (date '1995-01-01' + (s_suppkey * 11 % 2000 + s_suppkey % 60)::int)::date end_date,
       abs(s_acctbal)::decimal(12,2)::double budget_eur, 'all' target_segment,
       {pick(["email", "instagram", "google"], "s_suppkey")} utm_source, {pick(["lifecycle", "social", "cpc"], "s_suppkey")} utm_medium,
       'campaign_' || s_suppkey utm_campaign, s_suppkey % 60 campaign_duration_days,
       (date '1995-01-01' + (s_suppkey * 11 % 2000)::int)::timestamp loaded_at
from supplier
"""
FINALS["m09_stg_campaign_attributions"] = f"""
select 'ATT-' || o_orderkey attribution_id, o_custkey::varchar customer_id, 'CAMP_' || (o_orderkey % 25) campaign_id,
       o_orderkey::varchar order_id, 'CAMP_' || (o_orderkey % 7) first_touch_campaign_id,
       'CAMP_' || (o_orderkey % 25) last_touch_campaign_id, o_totalprice::decimal(10,2)::double attributed_revenue_eur,
       {pick(["last_touch", "first_touch", "linear"], "o_orderkey")} attribution_model, o_orderdate loaded_at
from orders
"""
FINALS["m10_stg_web_events"] = f"""
select event_id::varchar event_id, user_id || '-' || strftime(ts, '%Y%m%d') session_id,
       if(user_id % 10 = 0, null, user_id::varchar) customer_id,
       map {{'click': 'add_to_cart', 'view': 'page_view', 'purchase': 'checkout_complete', 'signup': 'product_view',
            'error': 'search'}}[event_type] event_type,
       ts event_timestamp, ts::date event_date, '/p/' || (event_id % 100) page_url,
       if(event_type in ('view', 'error'), null, (event_id % 1000)::varchar) product_id,
       {pick(["desktop", "mobile", "tablet"], "event_id")} device_type,
       {pick(["firefox", "chrome", "safari", "edge"], "event_id")} browser,
       if(event_id % 2 = 0, null, 'newsletter') utm_source, user_id % 10 <> 0 is_authenticated, ts loaded_at
from events
"""

# ---------------------------------------------------------------- intermediate
FINALS["m11_int_orders_enriched"] = """
select order_id, customer_id, order_date, channel, order_status, shipping_country, shipping_method, discount_code,
       discount_amount::double discount_amount, item_count, total_quantity, gross::double gross_revenue,
       discount_amount::double discount_amount_hdr, net::double net_revenue, names product_categories,
       sent_back has_returned, is_first is_first_order
from b_orders
"""
FINALS["m12_int_customer_order_summary"] = """
select * replace (total_revenue::double as total_revenue) from b_buyers
"""
FINALS["m13_dim_date"] = """
with d as (select unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day))::date t from orders)
select t date_day, strftime(t, '%Y%m%d')::int date_key, dayofweek(t) day_of_week, strftime(t, '%a') day_name, month(t) month_num,
       strftime(t, '%b') month_name, quarter(t) as quarter, year(t) as year, dayofweek(t) in (0, 6) is_weekend,
       dayofweek(t) between 1 and 5 is_weekday, weekofyear(t) week_of_year, dayofyear(t) day_of_year,
       day(t) = 1 is_first_day_of_month, month(t + 1) <> month(t) is_last_day_of_month,
       'FQ' || (case when month(t) < 4 then 4 else quarter(t) - 1 end) fiscal_quarter,
       year(t) - (month(t) < 4)::int fiscal_year,
       case when month(t) between 3 and 5 then 'Spring' when month(t) between 6 and 8 then 'Summer'
            when month(t) between 9 and 11 then 'Autumn' else 'Winter' end season,
       strftime(t, '%Y-%m') year_month, strftime(t, '%Y') year_str
from d
"""
FINALS["m14_int_payment_summary"] = """
select order_id, total_paid_eur::double total_paid_eur, payment_method, gateway, payment_status, refund_count,
       total_refunded_eur::double total_refunded_eur, is_refunded, date_diff('day', order_date, last_payment) days_to_payment
from b_paid left join s_orders using (order_id)
"""
FINALS["m15_int_shipment_summary"] = """
select order_id, shipment_id, carrier, tracking_number, shipment_status, shipped_at, delivered_at, estimated_delivery_date,
       date_diff('day', order_date, shipped_at) days_to_ship, days_to_deliver,
       date_diff('day', order_date, delivered_at) total_fulfillment_days, is_late_delivery
from b_shipped left join (select order_id, order_date from s_orders) using (order_id)
"""
FINALS["m16_int_product_performance"] = """
select * replace (total_revenue::double as total_revenue) from b_sold
"""

# ---------------------------------------------------------------- core marts
FINALS["m17_dim_customers"] = """
select * replace (lifetime_value_eur::double as lifetime_value_eur) from d_customers
"""
FINALS["m18_dim_products"] = """
select * replace (current_price::double as current_price, cost_price::double as cost_price, margin_pct::double as margin_pct,
                  total_revenue::double as total_revenue, return_rate::double as return_rate,
                  avg_days_to_return::double as avg_days_to_return) from d_products
"""
ORDERS_OUT = """
select * exclude (keep) replace (gross_revenue_eur::double as gross_revenue_eur, discount_amount_eur::double as discount_amount_eur,
       net_revenue_eur::double as net_revenue_eur, total_paid_eur::double as total_paid_eur) from f_orders
"""
FINALS["m19_fct_orders"] = ORDERS_OUT
FINALS["m20_fct_order_items"] = """
select * exclude (keep) replace (unit_price_eur::double as unit_price_eur, discount_pct::double as discount_pct,
       line_revenue_eur::double as line_revenue_eur) from f_items
"""
FINALS["m21_fct_payments"] = """
select * replace (amount_original::double as amount_original, amount_eur::double as amount_eur) from f_payments
"""

# ---------------------------------------------------------------- finance
FINALS["m22_fct_revenue"] = f"""
with d as (
  select order_date date_day, channel, shipping_country country, count(*) order_count, sum(gross_revenue_eur) gross,
         sum(discount_amount_eur) off, sum(net_revenue_eur) net, {avg_of("net_revenue_eur")} aov
  from f_orders where keep group by all)
select date_day, channel, country, order_count, gross::double gross_revenue_eur, off::double discount_eur, net::double net_revenue_eur,
       aov avg_order_value_eur,
       (select sum(e.net) from d e where e.channel = d.channel and e.country = d.country and e.date_day <= d.date_day
          and e.date_day >= date_trunc('month', d.date_day))::double cumulative_mtd_revenue,
       (select sum(e.net) from d e where e.channel = d.channel and e.country = d.country and e.date_day <= d.date_day
          and e.date_day >= date_trunc('year', d.date_day))::double cumulative_ytd_revenue
from d
"""
FINALS["m23_fct_refunds"] = f"""
with refunds as (select * from f_payments where payment_status = 'refunded'),
months as (select date_trunc('month', order_date) m, sum(net_revenue_eur) revenue from f_orders group by all)
select payment_id, r.order_id, r.customer_id, payment_date refund_date, r.order_date, o.channel, o.shipping_country, o.order_status,
       amount_eur::double refund_amount_eur, days_to_payment days_to_refund,
       count(*) over same_month monthly_refund_count, (sum(amount_eur) over same_month)::double monthly_total_refunds_eur,
       {pct("sum(amount_eur) over same_month", "revenue")} monthly_refund_rate_pct
from refunds r left join f_orders o using (order_id) left join months on m = date_trunc('month', r.order_date)
window same_month as (partition by year(payment_date), month(payment_date))
"""
FINALS["m24_monthly_revenue_summary"] = f"""
with m as (
  select strftime(order_date, '%Y-%m') year_month, year(order_date) as year, month(order_date) month_num,
         count(distinct order_id) total_orders, sum(net_revenue_eur) revenue, {avg_of("net_revenue_eur")} avg_order_value_eur,
         count(distinct customer_id) active_customers, count(*) filter (where is_first_order) new_customers,
         count(*) filter (where not is_first_order) returning_customers,
         coalesce(sum(net_revenue_eur) filter (where is_first_order), 0) new_net,
         coalesce(sum(net_revenue_eur) filter (where not is_first_order), 0) old_net
  from f_orders where keep group by all),
n as (select *, lag(revenue) over t prev_net, lag(revenue, 12) over t year_net, lag(total_orders) over t prev_orders
      from m window t as (order by year_month))
select year_month, year, month_num, total_orders, revenue::double revenue_eur, avg_order_value_eur, active_customers, new_customers,
       returning_customers, new_net::double new_customer_revenue_eur, old_net::double returning_customer_revenue_eur,
       {pct("revenue - prev_net", "prev_net")} mom_revenue_growth_pct, {pct("revenue - year_net", "year_net")} yoy_revenue_growth_pct,
       {pct("total_orders - prev_orders", "prev_orders")} mom_orders_growth_pct
from n
"""
FINALS["m25_product_margin_analysis"] = f"""
with s as (
  select product_id, count(distinct order_id) total_orders, sum(quantity)::bigint units_sold, sum(line_revenue_eur) revenue,
         sum(quantity * cost_price) spent, {avg_of("unit_price_eur")} asp,
         (sum((unit_price_eur * 100)::hugeint) * 2000000 + count(unit_price_eur)) // (2 * count(unit_price_eur)) asp_units
  from f_items join s_products using (product_id) where keep group by all),
p as (
  select d.product_id, product_name, category, subcategory, collection, unit_price price, cost_price cost, margin_pct,
         coalesce(total_orders, 0) total_orders, coalesce(units_sold, 0) units_sold, coalesce(revenue, 0) revenue,
         coalesce(spent, 0) spent, coalesce(asp, price) asp, coalesce(asp_units, (price * 100000000)::hugeint) asp_units
  from s_products d left join s using (product_id))
select product_id, product_name, category, subcategory, collection, price::double current_price, cost::double cost_price,
       margin_pct::double catalog_margin_pct, total_orders, units_sold, revenue::double total_revenue_eur, spent::double total_cost_eur,
       (revenue - spent)::double gross_margin_eur,
       if(revenue > 0, {pct("revenue - spent", "revenue")}, margin_pct) realized_margin_pct, asp avg_selling_price_eur,
       'product' aggregation_level
from p
union all by name
select category, {avg_of("price")} current_price, {avg_of("cost")} cost_price, {avg_of("margin_pct")} catalog_margin_pct,
       sum(total_orders)::bigint total_orders, sum(units_sold)::bigint units_sold, sum(revenue)::double total_revenue_eur,
       sum(spent)::double total_cost_eur, sum(revenue - spent)::double gross_margin_eur,
       {pct("sum(revenue - spent)", "sum(revenue)")} realized_margin_pct,
       {avg_of("asp_units")} / 100000000 avg_selling_price_eur, 'category' aggregation_level
from p group by category
"""
FINALS["m26_daily_flash_report"] = f"""
with d as (
  select order_date t, count(*) n, sum(net_revenue_eur) net, {avg_of("net_revenue_eur")} aov from f_orders where keep group by all)
select a.t date_day, a.n orders, a.net::double revenue_eur, a.aov aov_eur, coalesce(b.n, 0) py_orders,
       coalesce(b.net, 0)::double py_revenue_eur, coalesce(b.aov, 0) py_aov_eur,
       {pct("a.net - b.net", "b.net")} revenue_vs_py_pct, {pct("a.n - b.n", "b.n")} orders_vs_py_pct
from d a left join d b on b.t = (a.t - interval 1 year)::date
where a.t >= ({TODAY} - 30)
"""
FINALS["m27_country_revenue_breakdown"] = f"""
with y as (
  select shipping_country country, year(order_date) - year({TODAY}) age, count(*) n, sum(net_revenue_eur) net
  from f_orders where keep group by all),
z as (select a.country, a.n, a.net, coalesce(b.net, 0) before
      from y a left join y b on b.country = a.country and b.age = -1 where a.age = 0)
select country, n total_orders, net::double total_revenue_eur, {pct("net", "(select sum(net) from z)")} pct_of_total_revenue,
       before::double py_revenue_eur, {pct("net - before", "before")} yoy_growth_pct
from z
"""

# ---------------------------------------------------------------- marketing
FINALS["m28_customer_segments"] = f"""
with s as (
  select *, case when days_since_last_order is null then 1 else 5 - (days_since_last_order > 30)::int - (days_since_last_order > 60)::int
                 - (days_since_last_order > 90)::int - (days_since_last_order > 180)::int end r,
         case when total_orders = 0 then 1 when total_orders = 1 then 2 when total_orders < 4 then 3 when total_orders < 7 then 4 else 5 end f,
         case when lifetime_value_eur = 0 then 1 else 2 + (lifetime_value_eur >= 200)::int + (lifetime_value_eur >= 600)::int
              + (lifetime_value_eur >= 1500)::int end m
  from d_customers)
select customer_id, full_name, email, country, loyalty_tier, acquisition_channel, customer_status, total_orders order_count,
       lifetime_value_eur::double lifetime_value_eur, days_since_last_order, last_order_date, first_order_date, favorite_category,
       r recency_score, f frequency_score, m monetary_score, r + f + m rfm_total_score,
       case when least(r, f, m) >= 4 then 'Champions' when least(r, f) >= 3 then 'Loyal' when r > 3 then 'New'
            when r = 3 then if(m > 3, 'Potential Loyalist', 'Promising')
            when f >= 3 then if(m >= 3, 'At Risk', 'Cant Lose Them') when m >= 3 then 'Hibernating'
            when r = 1 then 'Lost' else 'Promising' end rfm_segment, {TODAY} segmented_at
from s
"""
FINALS["m29_customer_ltv"] = f"""
with g as (select c.*, if(gap > 0, {rate("365.0", "gap")}, null) yearly from d_customers c left join x_gaps using (customer_id) where total_orders > 0)
select customer_id, full_name, country, loyalty_tier, acquisition_channel, signup_date, strftime(first_order_date, '%Y-%m') cohort_month,
       total_orders, lifetime_value_eur::double lifetime_value_eur, avg_order_value_eur, days_since_last_order, customer_tenure_days,
       coalesce(yearly, total_orders)::double estimated_annual_frequency,
       round((avg_order_value_eur * coalesce(yearly, 1))::decimal(28,8), 2)::double predicted_12m_ltv_eur,
       if(lifetime_value_eur >= 2000, 'High LTV', if(lifetime_value_eur >= 600, 'Medium LTV', 'Low LTV')) ltv_segment, {TODAY} calculated_at
from g
"""
FINALS["m30_cohort_analysis"] = f"""
with c as (select *, date_trunc('month', signup_date) j, count(*) over (partition by date_trunc('month', signup_date)) base from s_customers),
a as (select j, base, date_trunc('month', order_date) o, count(distinct c.customer_id) people, count(distinct order_id) n, sum(net) net
      from c join b_orders using (customer_id) where keep and order_status <> 'returned' group by all)
select strftime(j, '%Y-%m') signup_cohort_month, strftime(o, '%Y-%m') order_cohort_month, base cohort_base_size, people active_customers,
       n cohort_order_count, net::double cohort_revenue, {pct("people", "base")} retention_rate_pct, date_diff('month', j, o) period_number
from a
"""
FINALS["m31_channel_attribution"] = f"""
with o as (select b.*, acquisition_channel origin from b_orders b left join s_customers using (customer_id) where order_status = 'delivered'),
half as (select channel, net from o union all select origin, net from o where origin is not null)
select channel, sum(net)::double last_touch_revenue_eur, count(*) last_touch_orders,
       coalesce((select sum(net) from o f where f.origin = o.channel and is_first), 0)::double first_touch_revenue_eur,
       (select count(*) from o f where f.origin = o.channel and is_first) first_touch_orders,
       (select sum(net) * 0.5 from half h where h.channel = o.channel)::double linear_revenue_eur,
       {pct("sum(net)", "(select sum(net) from o)")} last_touch_pct_of_total, {TODAY} calculated_at
from o group by channel
"""
FINALS["m32_fct_campaign_performance"] = f"""
with w as (select channel campaign_id, (order_date - (isodow(order_date) - 1)::int)::date week_start, count(*) conversions, sum(net) net
           from b_orders where order_status = 'delivered' group by all)
select campaign_id, week_start, 'last_touch' attribution_model, conversions, net::double attributed_revenue_eur,
       {rate("net", "net * 0.1")} roas, {rate("net * 0.1", "conversions")} cpa_eur, {TODAY} calculated_at
from w
"""

# ---------------------------------------------------------------- data science
FINALS["m33_customer_features"] = """
select customer_id, snapshot_date, days_since_last_order recency_days, total_orders frequency_orders,
       lifetime_value_eur::double monetary_value, avg_order_value_eur avg_order_value,
       std_order_value, preferred_channel, distinct_channels_used,
       favorite_category preferred_category, days_since_signup, loyalty_tier_encoded, has_returned_items, return_rate, active_flag,
       gender, country, acquisition_channel, customer_status, customer_tenure_days
from x_features
"""
FINALS["m34_order_sequence_features"] = """
with s as (
  select *, row_number() over t nth, lag(order_date) over t prev_day, lag(net) over t prev_net,
         len(list_distinct(list(channel) over (partition by customer_id))) channels
  from b_orders where keep window t as (partition by customer_id order by order_date, order_id))
select customer_id, order_id, nth order_number, order_date, net::double net_revenue_eur, channel,
       date_diff('day', prev_day, order_date) days_between_orders,
       if(prev_net is null, 'first_order', if(net > prev_net * 1.1, 'growing', if(net < prev_net * 0.9, 'declining', 'stable'))) aov_trend,
       if(channels = 1, 'consistent', if(channels = 2, 'mixed', 'omnichannel')) channel_consistency, channels total_distinct_channels
from s
"""
FINALS["m35_product_affinity_features"] = """
with k as (select order_id, product_id from f_items where keep),
b as (select order_id, count(distinct product_id) width from k group by all),
w as (select product_id, sum(width)::double / count(*) mean_width from k join b using (order_id) group by all),
t as (select l.product_id, r.product_id mate, count(distinct order_id) n
      from k l join k r using (order_id) where l.product_id <> r.product_id group by l.product_id, r.product_id
      qualify row_number() over (partition by l.product_id order by count(distinct order_id) desc, r.product_id) = 1)
select p.product_id, p.product_name, p.category, p.current_price::double current_price, p.performance_tier, mate cross_sell_product_id,
       q.product_name cross_sell_product_name, q.category cross_sell_category, coalesce(n, 0) affinity_score,
       coalesce(mean_width, 1) avg_basket_size_with_product
from d_products p left join t using (product_id) left join d_products q on q.product_id = mate left join w on w.product_id = p.product_id
"""
FINALS["m36_churn_prediction_input"] = """
select customer_id, snapshot_date, days_since_last_order is null or days_since_last_order > 180 is_churned,
       days_since_last_order days_since_last_purchase, total_orders frequency_orders, lifetime_value_eur::double monetary_value,
       avg_order_value_eur avg_order_value, std_order_value, preferred_channel,
       distinct_channels_used, favorite_category preferred_category, days_since_signup, loyalty_tier_encoded, has_returned_items,
       return_rate, active_flag, gender, country, acquisition_channel, customer_tenure_days,
       null::double predicted_churn_probability_placeholder
from x_features
"""
FINALS["m37_customer_lifetime_value_features"] = f"""
with months as (select customer_id, count(distinct strftime(order_date, '%Y-%m')) n, count(*) orders_n from b_orders where keep group by all)
select x.customer_id, snapshot_date, days_since_signup // 30 months_since_signup, customer_tenure_days, total_orders order_count_so_far,
       lifetime_value_eur::double cumulative_revenue_so_far, avg_order_value_eur avg_order_value, coalesce(gap, 0) avg_inter_order_days,
       if(gap > 0, {pct("days_since_last_order", "gap", 1)}, null) pct_of_avg_cycle_elapsed,
       coalesce(orders_n::double / n, 0) orders_per_active_month, coalesce(n, 0) active_purchase_months, loyalty_tier_encoded,
       preferred_channel, favorite_category preferred_category, has_returned_items, return_rate, gender, country, acquisition_channel,
       ['very_low','low','medium','high','elite'][1 + (lifetime_value_eur >= 200)::int + (lifetime_value_eur >= 600)::int
         + (lifetime_value_eur >= 1500)::int + (lifetime_value_eur >= 3000)::int] ltv_tier_label
from x_features x left join x_gaps using (customer_id) left join months using (customer_id)
"""
FINALS["m38_recommendation_input"] = f"""
select customer_id, product_id, any_value(product_name) product_name, any_value(category) category, count(*) purchase_count,
       sum(quantity)::bigint total_units, sum(line_revenue_eur)::double revenue, max(order_date) last_purchased_date,
       min(order_date) first_purchased_date, round(ln(sum(line_revenue_eur)::double + 1)::decimal(28,8), 4)::double implicit_rating,
       date_diff('day', max(order_date), {TODAY}) days_since_purchase
from f_items join s_products using (product_id) where keep group by customer_id, product_id
"""


