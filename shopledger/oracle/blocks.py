"""Named SQL blocks: staging over the benchmark tables, then building blocks and marts.

Every block is written from the model specification, on purpose in another way than the Spark code:
windows where Spark aggregates, joins where Spark pre-aggregates.
"""

TODAY = "date '2001-08-01'"
LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def pct(a: str, b: str, places: int = 2) -> str:
    return f"round(((({a})::double / nullif(({b})::double, 0)) * 100)::decimal(28,8), {places})::double"


def rate(a: str, b: str, places: int = 2) -> str:
    return f"round((({a})::double / nullif(({b})::double, 0))::decimal(28,8), {places})::double"


def avg_of(x: str, where: str = "") -> str:
    tail = f" filter (where {where})" if where else ""
    return f"(sum({x}){tail})::double / nullif(count({x}){tail}, 0)"


def pick(values: list[str], n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][(({n}) % {len(values)})::int + 1]"


BLOCKS: dict[str, str] = {}

# ---------------------------------------------------------------- staging
BLOCKS["s_customers"] = """
select c_custkey::varchar customer_id, c_name[1:8] first_name, c_name[10:] last_name,
       lower(c_name || '@Example.COM') email, null::varchar phone,
       (date '1950-01-01' + (c_custkey * 37 % 18000)::int)::date birth_date,
       ['M','F','Other'][(c_custkey % 3)::int + 1] gender, n_name city, n_name country,
       (date '1994-10-01' + (c_custkey % 900)::int)::date signup_date,
       case when c_acctbal >= 7500 then 'Platinum' when c_acctbal >= 5000 then 'Gold'
            when c_acctbal >= 2500 then 'Silver' else 'Bronze' end loyalty_tier,
       map {'AUTOMOBILE': '1-URGENT', 'BUILDING': '2-HIGH', 'FURNITURE': '3-MEDIUM',
            'HOUSEHOLD': '5-LOW', 'MACHINERY': 'wholesale'}[c_mktsegment] acquisition_channel
from customer left join nation on n_nationkey = c_nationkey
"""

BLOCKS["s_products"] = f"""
with p as (select *, p_retailprice::decimal(10,2) price, round(p_retailprice::decimal(10,2) * 0.35, 2)::decimal(10,2) unit_cost from part)
select p_partkey::varchar product_id, p_name product_name, p_type category, 'Size ' || p_size subcategory,
       {pick(["Full Grain Leather", "Genuine Leather", "Suede", "Canvas", "Patent Leather"], "p_size")} material,
       split_part(p_name, ' ', 1) color, price unit_price, unit_cost cost_price, (price - unit_cost)::decimal(10,2) gross_margin,
       case when price > 0 then {pct("price - unit_cost", "price")} end::decimal(10,4) margin_pct,
       'SKU-' || p_partkey sku_code, p_brand collection, p_partkey % 10 <> 0 is_active,
       (date '1994-01-01' + (p_partkey % 365)::int)::date launched_at
from p
"""

BLOCKS["s_orders"] = """
select o_orderkey::varchar order_id, o_custkey::varchar customer_id, o_orderdate::date order_date,
       case o_orderstatus when 'F' then if(o_orderkey % 13 = 0, 'returned', 'delivered')
                          when 'O' then if(o_orderkey % 17 = 0, 'cancelled', 'confirmed')
                          else 'pending' end order_status,
       o_orderpriority channel, 'CITY_' || (o_orderkey % 40) shipping_city,
       'NATION_' || (o_custkey % 25) shipping_country,
       ['standard','express','pickup'][(o_orderkey % 3)::int + 1] shipping_method,
       if(o_orderkey % 5 = 0, 'PROMO10', null) discount_code,
       if(o_orderkey % 5 = 0, 10, 0)::decimal(10,2) discount_amount
from orders
"""

BLOCKS["s_items"] = f"""
with l as (select *, {LINE_ID} line_id, l_discount::decimal(5,2) share,
                  {rate("l_extendedprice::decimal(18,2)", "l_quantity")}::decimal(10,2) unit_price from lineitem)
select line_id order_item_id, l_orderkey::varchar order_id, l_partkey::varchar product_id,
       l_quantity::decimal(5,0) quantity, unit_price unit_price_at_order, (share * 100)::decimal(5,2) discount_pct,
       round(l_quantity::decimal(5,0) * unit_price * (1 - share), 2)::decimal(18,2) line_revenue, l_shipdate loaded_at
from l
"""

BLOCKS["s_payments"] = f"""
with attempts as (
  select *, false failed from orders
  union all select *, true from orders where o_orderkey % 10 = 0),
paid as (select *, o_totalprice::decimal(10,2) cash, {pick(["EUR", "gbp", "USD", "CHF", "JPY"], "o_orderkey")} coin from attempts)
select 'PAY-' || o_orderkey || if(failed, '-F', '') payment_id, o_orderkey::varchar order_id,
       (o_orderdate::date + (o_orderkey % 7)::int - failed::int)::date payment_date,
       {pick(["card", "wallet", "giro", "voucher"], "o_orderkey")} payment_method,
       cash amount, coin currency,
       round(cash * coalesce(map {{'EUR': 1.00, 'GBP': 1.17, 'USD': 0.92, 'CHF': 1.03}}[upper(coin)], 1.00), 2)::decimal(18,2) amount_eur,
       if(failed, 'failed', coalesce(map {{'F': 'completed', 'O': 'pending'}}[o_orderstatus], 'refunded')) payment_status,
       {pick(["north_pay", "quick_pay", "desk", "counter"], "o_orderkey")} gateway
from paid
"""

BLOCKS["s_shipments"] = f"""
select 'SHP-' || {LINE_ID} shipment_id, l_orderkey::varchar order_id,
       {pick(["Northline", "Swiftbox", "Parcelia", "Roadhawk", "Blueways"], "l_suppkey")} carrier, 'TRK-' || {LINE_ID} tracking_number,
       (l_shipdate::date + 5)::date estimated_delivery_date,
       if(l_linestatus = 'O' and l_linenumber = 1, null, l_shipdate::date) shipped_at,
       if(l_linestatus = 'F', (l_shipdate::date + l_quantity::int % 12)::date, null) delivered_at,
       if(l_linestatus = 'F', 'delivered', 'in_transit') shipment_status, l_shipdate loaded_at
from lineitem
"""

BLOCKS["s_returns"] = f"""
select 'RET-' || {LINE_ID} return_id, l_orderkey::varchar order_id, if(l_linenumber = 5, null, {LINE_ID}) order_item_id,
       {pick(["too_small", "second_thoughts", "other_than_shown", "broken", "received_twice", "poor_finish"], "l_suppkey")} return_reason,
       (l_shipdate::date + 5)::date return_requested_at, (l_shipdate::date + 12)::date return_received_at,
       l_extendedprice::decimal(10,2) refund_amount,
       {pick(["pending", "approved", "completed", "rejected"], "l_linenumber")} refund_status
from lineitem where l_returnflag = 'R'
"""

# ---------------------------------------------------------------- building blocks
BLOCKS["b_lines"] = """
select i.*, p.category, p.product_id is not null known
from s_items i left join s_products p using (product_id)
"""

BLOCKS["b_orders"] = """
with basket as (
  select order_id, count(*) pieces, sum(quantity)::bigint units, sum(line_revenue)::decimal(18,2) gross,
         coalesce(string_agg(distinct category, ', ' order by category), '') names
  from b_lines group by all)
select o.*, coalesce(pieces, 0) item_count, coalesce(units, 0) total_quantity,
       coalesce(gross, 0)::decimal(18,2) gross, (coalesce(gross, 0) - discount_amount)::decimal(18,2) net, names,
       exists (from s_returns r where r.order_id = o.order_id) sent_back,
       order_date = min(order_date) over (partition by customer_id) is_first,
       order_status not in ('cancelled', 'pending') keep
from s_orders o left join basket using (order_id)
"""

BLOCKS["b_buyers"] = f"""
with spend as (
  select customer_id, count(*) total_orders, sum(net)::decimal(18,2) total_revenue, {avg_of("net")} avg_order_value,
         min(order_date) first_order_date, max(order_date) last_order_date
  from b_orders where keep group by all),
taste as (
  select customer_id, category from b_orders join b_lines using (order_id) where keep and known
  group by customer_id, category qualify row_number() over (partition by customer_id order by count(*) desc, category) = 1),
back as (select customer_id, count(*) pieces from s_orders join s_returns using (order_id) group by all)
select spend.*, date_diff('day', last_order_date, {TODAY}) days_since_last_order,
       date_diff('day', first_order_date, {TODAY}) customer_tenure_days, category favorite_category,
       coalesce(pieces, 0) total_items_returned
from spend left join taste using (customer_id) left join back using (customer_id)
"""

BLOCKS["b_paid"] = """
select order_id, coalesce(sum(amount_eur) filter (where payment_status = 'completed'), 0)::decimal(18,2) total_paid_eur,
       max(payment_method) filter (where payment_status = 'completed') payment_method,
       max(gateway) filter (where payment_status = 'completed') gateway, max(payment_status) payment_status,
       count(*) filter (where payment_status = 'refunded') refund_count,
       coalesce(sum(amount_eur) filter (where payment_status = 'refunded'), 0)::decimal(18,2) total_refunded_eur,
       bool_or(payment_status = 'refunded') is_refunded, max(payment_date) last_payment
from s_payments group by all
"""

BLOCKS["b_shipped"] = """
select s.*, date_diff('day', shipped_at, delivered_at) days_to_deliver,
       coalesce(date_diff('day', shipped_at, delivered_at) > 7, false) is_late_delivery
from s_shipments s
qualify row_number() over (partition by order_id order by shipped_at asc nulls last, shipment_id) = 1
"""

BLOCKS["b_sold"] = f"""
with sales as (
  select i.*, o.order_date from s_items i join s_orders o using (order_id)
  where order_status not in ('cancelled', 'pending')),
sums as (
  select product_id, count(distinct order_id) total_orders, sum(quantity)::bigint total_units_sold,
         sum(line_revenue)::decimal(18,2) total_revenue, min(order_date) first_sold_date, max(order_date) last_sold_date
  from sales group by all),
back as (
  select product_id, count(*) return_count, {avg_of("date_diff('day', order_date, return_requested_at)")} avg_days_to_return
  from sales join s_returns using (order_item_id) group by all)
select sums.*, coalesce(return_count, 0) return_count,
       coalesce({pct("coalesce(return_count, 0)", "total_units_sold")}, 0) return_rate, avg_days_to_return
from sums left join back using (product_id)
"""

# ---------------------------------------------------------------- marts
BLOCKS["d_customers"] = f"""
select c.customer_id, first_name, last_name, first_name || ' ' || last_name full_name, email, city, country, birth_date,
       year({TODAY}) - year(birth_date) age, gender, signup_date, loyalty_tier, acquisition_channel,
       coalesce(total_orders, 0) total_orders, coalesce(total_revenue, 0)::decimal(18,2) lifetime_value_eur,
       coalesce(avg_order_value, 0) avg_order_value_eur, first_order_date, last_order_date, days_since_last_order,
       customer_tenure_days, favorite_category, coalesce(total_items_returned, 0) total_items_returned,
       case when total_orders is null then 'prospect' when days_since_last_order <= 90 then 'active'
            when days_since_last_order <= 365 then 'at_risk' else 'churned' end customer_status
from s_customers c left join b_buyers b using (customer_id)
"""

BLOCKS["d_products"] = """
select p.product_id, product_name, category, subcategory, material, color, unit_price current_price, cost_price, margin_pct,
       sku_code, collection, is_active, launched_at, coalesce(total_orders, 0) total_orders,
       coalesce(total_units_sold, 0) total_units_sold, coalesce(b.total_revenue, 0)::decimal(18,2) total_revenue,
       coalesce(return_rate, 0)::decimal(10,4) return_rate,
       round(avg_days_to_return::decimal(28,8), 2)::decimal(10,2) avg_days_to_return, first_sold_date, last_sold_date,
       ['hero','core','niche','long_tail'][ntile(4) over (order by coalesce(b.total_revenue, 0) desc, p.product_id)] performance_tier
from s_products p left join b_sold b using (product_id)
"""

BLOCKS["f_orders"] = """
select o.order_id, customer_id, order_date, strftime(order_date, '%Y%m%d')::int order_date_key, channel, order_status,
       shipping_country, shipping_method, discount_code, item_count, total_quantity, gross gross_revenue_eur,
       discount_amount::decimal(18,2) discount_amount_eur, net net_revenue_eur, names product_categories,
       sent_back has_returned, is_first is_first_order, coalesce(p.payment_method, 'unknown') payment_method,
       coalesce(p.payment_status, 'unknown') payment_status, total_paid_eur, is_refunded, carrier, shipment_status,
       coalesce(date_diff('day', order_date, shipped_at), 0) days_to_ship, days_to_deliver,
       coalesce(is_late_delivery, false) is_late_delivery, keep
from b_orders o left join b_paid p using (order_id) left join b_shipped s using (order_id)
"""

BLOCKS["f_items"] = """
select i.order_item_id, i.order_id, i.product_id, o.customer_id, o.order_date, o.order_status, quantity::bigint quantity,
       unit_price_at_order unit_price_eur, discount_pct, line_revenue line_revenue_eur,
       exists (from s_returns r where r.order_item_id = i.order_item_id and r.refund_status <> 'rejected') has_been_returned,
       o.order_status not in ('cancelled', 'pending') keep
from s_items i join s_orders o using (order_id)
"""

BLOCKS["f_payments"] = """
select payment_id, p.order_id, customer_id, payment_date, order_date, payment_method, gateway, currency,
       amount amount_original, amount_eur, payment_status, payment_status = 'refunded' is_refunded,
       date_diff('day', order_date, payment_date) days_to_payment
from s_payments p left join s_orders o using (order_id)
"""

BLOCKS["x_features"] = f"""
with cents as (select customer_id, channel, (net * 100)::hugeint c from b_orders where keep),
wide as (
  select customer_id, sqrt((count(c) * sum(c * c) - sum(c) * sum(c))::varchar::double / nullif(count(c) * (count(c) - 1), 0)) / 100 spread,
         count(distinct channel) channels from cents group by all),
fav as (
  select customer_id, channel from b_orders where keep group by customer_id, channel
  qualify row_number() over (partition by customer_id order by count(*) desc, channel) = 1)
select c.*, {TODAY} snapshot_date, coalesce(spread, 0) std_order_value, channel preferred_channel,
       coalesce(channels, 0) distinct_channels_used, date_diff('day', signup_date, {TODAY}) days_since_signup,
       coalesce(list_position(['Bronze','Silver','Gold','Platinum'], loyalty_tier), 0)::int loyalty_tier_encoded,
       total_items_returned > 0 has_returned_items,
       coalesce({rate("total_items_returned", "total_orders", 4)}, 0) return_rate, customer_status = 'active' active_flag
from d_customers c left join wide using (customer_id) left join fav using (customer_id)
"""

BLOCKS["x_gaps"] = """
select customer_id, avg(gap) gap from (
  select customer_id, date_diff('day', lag(order_date) over (partition by customer_id order by order_date), order_date) gap
  from b_orders where keep) where gap is not null group by all
"""
