"""The registered queries (imported by ``tillroll.registry``)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import apply
from tillroll.operators import reports as C
from tillroll.registry import (A0, AS_OF, DAY, DAY_PRED, END, FIG, MONTH, MONTH_PRED, Q0, RANGE_PRED, S, S0,
                               START, WEEK_START, YEAR, _b, register)

# ------------------------------------------------------------------ C: reports
register("c01_dashboard_today", f"select {FIG} from bills where cast(created_at as date) = date '2001-07-18' "
         "and status = 'completed'")(lambda t: C.dashboard_today(t, AS_OF))

register("c02_dashboard_week", f"select count(*) as total_transactions, {S0('net_amount')} as total_revenue "
         "from bills where created_at >= timestamp '2001-07-16 00:00:00' and status = 'completed'")(
    lambda t: C.dashboard_week(t, AS_OF))

register("c03_dashboard_month", f"select count(*) as total_transactions, {S0('net_amount')} as total_revenue "
         "from bills where created_at >= timestamp '2001-07-01 00:00:00' and status = 'completed'")(
    lambda t: C.dashboard_month(t, AS_OF))

register("c04_low_stock_count", "select count(*) as low_stock_alerts from products "
         "where is_active = true and stock_quantity <= minimum_stock")(C.low_stock_count)

_T = "created_at >= timestamp '2001-07-18 00:00:00' and created_at < timestamp '2001-07-19 00:00:00'"
_W = "created_at >= timestamp '2001-07-16 00:00:00'"
_M = "created_at >= timestamp '2001-07-01 00:00:00'"
register("c05_dashboard", f"""
select count(*) filter (where {_T}) as today_transactions,
       cast(coalesce(sum(net_amount) filter (where {_T}), 0) as decimal(18,2)) as today_revenue,
       cast(coalesce(sum(tax_amount) filter (where {_T}), 0) as decimal(18,2)) as today_tax,
       cast(coalesce(sum(discount_amount) filter (where {_T}), 0) as decimal(18,2)) as today_discounts,
       coalesce(cast(sum(net_amount) filter (where {_T}) as double) / nullif(count(net_amount) filter (where {_T}), 0), 0.0)
         as today_avg_transaction_value,
       count(*) filter (where {_W}) as week_transactions,
       cast(coalesce(sum(net_amount) filter (where {_W}), 0) as decimal(18,2)) as week_revenue,
       count(*) filter (where {_M}) as month_transactions,
       cast(coalesce(sum(net_amount) filter (where {_M}), 0) as decimal(18,2)) as month_revenue,
       (select count(*) from products where is_active = true and stock_quantity <= minimum_stock) as low_stock_alerts
from bills where status = 'completed' and created_at >= timestamp '2001-07-01 00:00:00'
""")(lambda t: C.dashboard(t, AS_OF))

register("c06_daily_summary", f"select {FIG}, count(distinct customer_id) as unique_customers from bills "
         f"where {DAY_PRED}")(lambda t: C.daily_summary(t, DAY))

register("c07_daily_hourly", f"select cast(extract(hour from created_at) as int) as hour, count(*) as transactions, "
         f"{S0('net_amount')} as revenue from bills where {DAY_PRED} group by 1 order by 1")(
    lambda t: C.daily_hourly(t, DAY))

register("c08_daily_payment_mix", f"select payment_method, count(*) as count, {S0('net_amount')} as amount "
         f"from bills where {DAY_PRED} group by payment_method order by amount desc")(
    lambda t: C.daily_payment_mix(t, DAY))

register("c09_daily_top_products", f"""
with chosen as (select product_id as id, sum(quantity) as units, sum(total_price) as taken from bill_items
  where bill_id in (select id from bills where {DAY_PRED}) group by product_id)
select id, name, cast(units as bigint) as total_sold, cast(taken as decimal(18,2)) as revenue
from chosen join products using (id) order by revenue desc, id limit 10""")(
    lambda t: C.daily_top_products(t, DAY))

_WK = f"created_at >= timestamp '{WEEK_START} 00:00:00' and created_at < timestamp '{WEEK_START} 00:00:00' " \
      "+ interval '7 days' and status = 'completed'"
register("c10_weekly_by_day", f"""
select cast(created_at as date) as date, rpad(strftime(created_at, '%A'), 9, ' ') as day_name,
       count(*) as total_transactions, {S0('net_amount')} as total_revenue, {S0('tax_amount')} as total_tax
from bills where {_WK} group by 1, 2 order by 1""")(lambda t: C.weekly_by_day(t, WEEK_START))

register("c11_weekly_totals", f"""
select count(*) as total_transactions, {S0('net_amount')} as total_revenue, {S0('tax_amount')} as total_tax,
       {A0('net_amount')} as avg_transaction_value from bills where {_WK}""")(
    lambda t: C.weekly_totals(t, WEEK_START))

register("c12_monthly_summary", f"select {FIG}, count(distinct customer_id) as unique_customers from bills "
         f"where {MONTH_PRED}")(lambda t: C.monthly_summary(t, YEAR, MONTH))

register("c13_monthly_by_week", f"""
select cast(date_trunc('week', created_at) as date) as week_start, count(*) as transactions,
       {S0('net_amount')} as revenue from bills where {MONTH_PRED} group by 1 order by 1""")(
    lambda t: C.monthly_by_week(t, YEAR, MONTH))

register("c14_monthly_by_department", f"""
with marks as (select product_id, total_price as taken, 0 as hit from bill_items
  union all select product_id, 0, 1 from bill_items where bill_id in (select id from bills where {MONTH_PRED})),
placed as (select department_id as id, sum(taken) as taken, sum(hit) as hits
  from (select product_id as id, sum(taken) as taken, sum(hit) as hit from marks group by 1) join products using (id) group by 1)
select name as department, cast(coalesce(hits, 0) as bigint) as transactions, cast(coalesce(taken, 0) as decimal(18,2)) as revenue
from departments left join placed using (id) order by revenue desc""")(lambda t: C.monthly_by_department(t, YEAR, MONTH))

register("c14_monthly_by_department_fixed", f"""
select d.name as department, cast(coalesce(x.n, 0) as bigint) as transactions,
       cast(coalesce(x.rev, 0) as decimal(18,2)) as revenue
from departments d left join (
  select p.department_id, count(distinct b.id) as n, sum(bi.total_price) as rev
  from bill_items bi join bills b on bi.bill_id = b.id join products p on bi.product_id = p.id
  where {_b(MONTH_PRED)} group by p.department_id) x on x.department_id = d.id
order by revenue desc""")(lambda t: C.monthly_by_department_fixed(t, YEAR, MONTH))

_C15 = f"""
with per_bill as (select department_id as id, bill_id, sum(quantity) as units, sum(total_price) as taken, sum(tax_amount) as tax
  from (select product_id as id, bill_id, quantity, total_price, tax_amount from bill_items
        where bill_id in (select id from bills where {RANGE_PRED})) join products using (id) group by 1, 2),
figures as (select id, count(*) as total_bills, cast(sum(units) as bigint) as items_sold,
  cast(sum(taken) as decimal(18,2)) as revenue, cast(sum(tax) as decimal(18,2)) as tax_collected from per_bill group by id)
select id, name as department, total_bills, items_sold, revenue, tax_collected from figures join departments using (id)"""
register("c15_department_report", _C15)(lambda t: C.department_report(t, START, END))

register("c15_department_report_fixed", f"""
select d.id, d.name as department, cast(coalesce(x.total_bills, 0) as bigint) as total_bills,
       cast(coalesce(x.items_sold, 0) as bigint) as items_sold, cast(coalesce(x.revenue, 0) as decimal(18,2)) as revenue,
       cast(coalesce(x.tax_collected, 0) as decimal(18,2)) as tax_collected
from departments d left join (
  select p.department_id, count(distinct b.id) as total_bills, sum(bi.quantity) as items_sold,
         sum(bi.total_price) as revenue, sum(bi.tax_amount) as tax_collected
  from bill_items bi join bills b on bi.bill_id = b.id join products p on bi.product_id = p.id
  where {_b(RANGE_PRED)} group by p.department_id) x on x.department_id = d.id
order by revenue desc""")(lambda t: C.department_report_fixed(t, START, END))

register("c16_product_report", f"""
with moved as (select product_id as id, sum(quantity) as units, sum(total_price) as taken, sum(tax_amount) as tax
  from bill_items group by product_id)
select id, name, sku, category, cast(coalesce(units, 0) as bigint) as total_sold, cast(coalesce(taken, 0) as decimal(18,2)) as revenue,
       cast(coalesce(tax, 0) as decimal(18,2)) as tax_collected, stock_quantity as current_stock
from products left join moved using (id) where is_active order by revenue desc, id limit 20""")(lambda t: C.product_report(t, START, END))

register("c16_product_report_fixed", f"""
select p.id, p.name, p.sku, p.category, cast(coalesce(x.q, 0) as bigint) as total_sold,
       cast(coalesce(x.rev, 0) as decimal(18,2)) as revenue, cast(coalesce(x.tax, 0) as decimal(18,2)) as tax_collected,
       p.stock_quantity as current_stock
from products p left join (
  select bi.product_id, sum(bi.quantity) as q, sum(bi.total_price) as rev, sum(bi.tax_amount) as tax
  from bill_items bi join bills b on bi.bill_id = b.id where {_b(RANGE_PRED)} group by bi.product_id) x
  on x.product_id = p.id
where p.is_active = true
order by revenue desc, p.id limit 20""")(lambda t: C.product_report_fixed(t, START, END))

register("c17_cashier_report", f"""
with took as (select cashier_id as id, count(*) as bills, sum(net_amount) as net, sum(discount_amount) as off
  from bills where {RANGE_PRED} group by cashier_id)
select id, name as cashier, coalesce(bills, 0) as total_bills, cast(coalesce(net, 0) as decimal(18,2)) as total_revenue,
       coalesce(cast(net as double) / bills, 0.0) as avg_bill_value, cast(coalesce(off, 0) as decimal(18,2)) as total_discounts
from users left join took using (id) where role = 'cashier' and is_active""")(lambda t: C.cashier_report(t, START, END))

register("c18_tax_summary", f"""
select count(*) as total_bills, {S0('net_amount')} as total_revenue, {S0('tax_amount')} as total_tax_collected
from bills where {RANGE_PRED}""")(lambda t: C.tax_summary(t, START, END))

register("c19_tax_by_rate", f"""
with per_bill as (select tax_rate, bill_id, sum(total_price) as taken, sum(tax_amount) as tax from bill_items
  where bill_id in (select id from bills where {RANGE_PRED}) group by 1, 2)
select tax_rate, cast(sum(taken) - sum(tax) as decimal(18,2)) as taxable_amount, cast(sum(tax) as decimal(18,2)) as tax_amount,
       count(*) as bills_count
from per_bill group by tax_rate""")(lambda t: C.tax_by_rate(t, START, END))

register("c20_top_products", f"""
with chosen as (select product_id as id, sum(quantity) as units, sum(total_price) as taken from bill_items
  where bill_id in (select id from bills where {RANGE_PRED}) group by product_id)
select id, name, sku, category, cast(units as bigint) as total_sold, cast(taken as decimal(18,2)) as revenue
from chosen join products using (id) order by total_sold desc, id limit 10""")(lambda t: C.top_products(t, START, END))

register("c21_top_customers", f"""
with spent as (select customer_id as id, count(*) as total_bills, cast(sum(net_amount) as decimal(18,2)) as total_spent
  from bills where {RANGE_PRED} group by customer_id)
select id, name, email, phone, loyalty_tier, total_bills, total_spent
from customers join spent using (id) order by total_spent desc, id limit 10""")(lambda t: C.top_customers(t, START, END))

# ------------------------------------------------------------------ B: listings
from tillroll.operators import listing as B  # noqa: E402
from tillroll.plans.paging import cursor_of  # noqa: E402
from tillroll.sources import workloads as W  # noqa: E402

# Names come from one keyed map per table; a page is the rows of its places in the whole order.
_NAMES = """buyer as (select map(list(id), list(name)) as of from customers),
clerk as (select map(list(id), list(name)) as of from users),
division as (select map(list(id), list(name)) as of from departments)"""
_BILL_LIST = f"""
with {_NAMES},
placed as (select b.*, row_number() over (order by b.created_at desc, b.id) as place from bills b where {{where}})
select id, bill_number, customer_id, (select of from buyer)[customer_id] as customer_name, total_amount, discount_amount,
       tax_amount, net_amount, payment_method, status, cashier_id, (select of from clerk)[cashier_id] as cashier_name, created_at
from placed where place between {{offset}} + 1 and {{offset}} + {{limit}}"""
_B1_WHERE = f"b.created_at >= timestamp '{START} 00:00:00' and b.created_at <= timestamp '{END} 00:00:00' " \
            "and b.status = 'completed'"
register("b01_bills_list", _BILL_LIST.format(where=_B1_WHERE, limit=20, offset=20))(
    lambda t: B.bills_list(t, start=START, end=END, status="completed", page_no=2)[0])
def _next_page(pages, column, descending, n):
    """The n-th page, reached by the cursor of each page before it; without rows if one of those has no cursor."""
    rows = pages(None)
    for _ in range(n - 1):
        cursor = cursor_of(rows, column, descending)
        if cursor is None:
            return rows.limit(0)
        rows = pages(cursor)
    return rows


register("b01_bills_list_cursor", _BILL_LIST.format(where=_B1_WHERE, limit=20, offset=40))(lambda t: _next_page(
    lambda c: B.bills_list(t, start=START, end=END, status="completed", cursor=c)[0], "created_at", True, 3))
register("b19_bills_list_total", f"select count(*) as total from bills b where {_B1_WHERE}")(
    lambda t: B.bills_total(t, start=START, end=END, status="completed"))
register("b20_bills_list_cashier", _BILL_LIST.format(where="b.cashier_id = 3", limit=20, offset=0))(
    lambda t: B.bills_list(t, role="cashier", user_id=3)[0])
register("b01_bills_list_customer", _BILL_LIST.format(where="b.customer_id = 1", limit=20, offset=0))(
    lambda t: B.bills_list(t, customer_id=1)[0])

_PRODUCT_LIST = f"""
with {_NAMES}, vendor as (select map(list(id), list(name)) as of from suppliers),
placed as (select p.*, row_number() over (order by p.name, p.id) as place from products p where {{where}})
select id, name, sku, barcode, price, tax_rate, stock_quantity, minimum_stock, unit, category, department_id,
       (select of from division)[department_id] as department_name, supplier_id, (select of from vendor)[supplier_id] as supplier_name
from placed where place between {{offset}} + 1 and {{offset}} + {{limit}}"""
_B2_WHERE = "p.is_active = true and p.stock_quantity > 0 and (p.name ilike '%gear%' or p.sku ilike '%gear%' " \
            "or p.barcode ilike '%gear%')"
register("b02_products_list", _PRODUCT_LIST.format(where=_B2_WHERE, limit=20, offset=20))(
    lambda t: B.products_list(t, in_stock=True, search="gear", page_no=2)[0])
register("b02_products_list_cursor", _PRODUCT_LIST.format(where="p.is_active = true", limit=20, offset=40))(
    lambda t: _next_page(lambda c: B.products_list(t, cursor=c)[0], "name", False, 3))
register("b19_products_list_total", f"select count(*) as total from products p where {_B2_WHERE}")(
    lambda t: B.products_total(t, in_stock=True, search="gear"))
register("b02_products_list_department", _PRODUCT_LIST.format(
    where="p.is_active = true and p.department_id = 3 and p.category = 'tool'", limit=20, offset=0))(
    lambda t: B.products_list(t, department_id=3, category="tool")[0])

_SEARCH = f"""
with {_NAMES},
hit as (select *, row_number() over (order by name, id) as place from products
        where is_active and (barcode = '{{term}}' or position('{{term}}' in lower(name)) > 0 or position('{{term}}' in lower(sku)) > 0))
select id, name, sku, barcode, price, tax_rate, stock_quantity, unit, category, department_id,
       (select of from division)[department_id] as department_name from hit where place <= 20"""
register("b03_product_search", _SEARCH.format(term="red"))(lambda t: B.product_search(t, "red"))
register("b03_product_search_barcode", _SEARCH.format(term="8900000000042"))(lambda t: B.product_search(t, "8900000000042"))

register("b04_low_stock", f"""
with {_NAMES}, vendor as (select map(list(id), list(struct_pack(n := name, e := contact_email))) as of from suppliers)
select id, name, sku, barcode, stock_quantity, minimum_stock, unit, department_id,
       (select of from division)[department_id] as department_name, supplier_id,
       (select of from vendor)[supplier_id].n as supplier_name, (select of from vendor)[supplier_id].e as supplier_email
from products where is_active and minimum_stock - stock_quantity >= 0""")(B.low_stock)

_B5_WHERE = "c.is_active = true and (c.name ilike '%00001%' or c.email ilike '%00001%' or c.phone ilike '%00001%')"
register("b05_customers_list", f"""
select c.id, c.name, c.email, c.phone, c.loyalty_points, c.loyalty_tier, c.total_purchases from customers c
where {_B5_WHERE} order by c.name, c.id limit 20""")(lambda t: B.customers_list(t, search="00001")[0])
register("b19_customers_list_total", f"select count(*) as total from customers c where {_B5_WHERE}")(
    lambda t: B.customers_list(t, search="00001")[1])
register("b05_customers_list_tier", """
select c.id, c.name, c.email, c.phone, c.loyalty_points, c.loyalty_tier, c.total_purchases from customers c
where c.is_active = true and c.loyalty_tier = 'gold' order by c.name, c.id limit 20 offset 40""")(
    lambda t: B.customers_list(t, tier="gold", page_no=3)[0])

_HIST = "id, bill_number, total_amount, discount_amount, tax_amount, net_amount, payment_method, status, created_at"
register("b06_customer_history", f"""
select {_HIST} from bills where customer_id = 1 order by created_at desc, id limit 10""")(
    lambda t: B.customer_history(t, 1))
register("b06_customer_history_all", f"""
select * from (select customer_id, {_HIST},
  row_number() over (partition by customer_id order by created_at desc, id) as rank
  from bills where customer_id is not null) x where rank <= 10""")(B.customer_history_all)
register("b07_customer_spend", """
select c.id, cast(coalesce(x.n, 0) as bigint) as total_bills, cast(coalesce(x.s, 0) as decimal(18,2)) as total_spent
from customers c left join (select customer_id, count(*) as n, sum(net_amount) as s from bills
  where status = 'completed' group by customer_id) x on x.customer_id = c.id""")(B.customer_spend)

register("b08_payments_list", f"""
select p.id, p.bill_id, b.bill_number, p.amount, p.method, p.status, p.gateway_transaction_id, p.created_at
from payments p left join bills b on p.bill_id = b.id
where p.created_at >= timestamp '{START} 00:00:00' and p.created_at <= timestamp '{END} 00:00:00'
  and p.method = 'razorpay' and p.status = 'refunded'
order by p.created_at desc, p.id limit 20""")(
    lambda t: B.payments_list(t, start=START, end=END, method="razorpay", status="refunded"))

register("b09_departments_list", f"""
with {_NAMES}
select id, name, description, manager_id, (select of from clerk)[manager_id] as manager_name, is_active, created_at
from departments where is_active""")(
    B.departments_list)
register("b10_department_stats", f"""
with stock as (select department_id as id, count(*) as kinds, sum(stock_quantity * price) as worth from products
  where is_active group by department_id),
heads as (select id as manager_id, name as manager_name from users)
select id, name, description, manager_id, manager_name, is_active, coalesce(kinds, 0) as product_count,
       cast(coalesce(worth, 0) as decimal(18,2)) as inventory_value
from departments left join heads using (manager_id) left join stock using (id) where is_active""")(B.department_stats)
register("b11_department_detail", f"""
with counted as (select id, sum(product) as products, sum(employee) as employees from (
    select department_id as id, 1 as product, 0 as employee from products where is_active
    union all select department_id, 0, 1 from users where is_active) group by id),
heads as (select id as manager_id, name as manager_name from users)
select id, name, description, manager_id, manager_name, is_active, cast(coalesce(products, 0) as bigint) as product_count,
       cast(coalesce(employees, 0) as bigint) as employee_count
from departments left join heads using (manager_id) left join counted using (id)""")(B.department_detail)

register("b12_bill_documents", """
select b.id, b.bill_number, c.name as customer_name, u.name as cashier_name, b.net_amount, b.status,
       cast(count(x.product_id) as bigint) as item_count, cast(coalesce(sum(x.quantity), 0) as bigint) as items_quantity,
       cast(coalesce(sum(x.total_price), 0) as decimal(18,2)) as items_total
from bills b left join customers c on b.customer_id = c.id left join users u on b.cashier_id = u.id
left join (select bi.* from bill_items bi join products p on bi.product_id = p.id) x on x.bill_id = b.id
group by b.id, b.bill_number, c.name, u.name, b.net_amount, b.status""")(
    lambda t: B.document_summary(B.bill_documents(t)))
register("b12_bill_document_lines", """
select bi.bill_id as id, cast(row_number() over (partition by bi.bill_id order by bi.product_id, p.name, p.sku, p.barcode,
         bi.quantity, bi.unit_price, bi.discount, bi.tax_rate, bi.tax_amount, bi.total_price) as int) as line_no,
       bi.product_id, p.name as product_name, p.sku, p.barcode, bi.quantity, bi.unit_price, bi.discount, bi.tax_rate,
       bi.tax_amount, bi.total_price
from bill_items bi join products p on bi.product_id = p.id where bi.bill_id in (select id from bills)""")(
    lambda t: B.document_lines(B.bill_documents(t)))

_SCANS = """(select event_id as scan_id, case event_type
   when 'view' then concat('890', lpad(cast(event_id as varchar), 10, '0'))
   when 'click' then concat('SKU', cast(event_id as varchar))
   when 'error' then concat('X', cast(event_id as varchar)) else cast(event_id as varchar) end as code from events)"""
register("b13_resolve_products", f"""
select s.scan_id, s.code, p.id as product_id, p.name, p.price, p.stock_quantity, p.department_id, p.supplier_id,
       d.name as department_name, sp.name as supplier_name
from {_SCANS} s left join products p on cast(p.id as varchar) = s.code or p.barcode = s.code or p.sku = s.code
left join departments d on p.department_id = d.id left join suppliers sp on p.supplier_id = sp.id""")(
    lambda t: B.resolve_products(t, W.scans(t.raw("events"))))

_CKEYS = """(select event_id as key_id, case event_type
   when 'view' then concat('+91-', lpad(cast(user_id as varchar), 10, '0'))
   when 'click' then concat('c', cast(user_id as varchar), '@mail.example')
   when 'error' then 'nobody@mail.example' else cast(user_id as varchar) end as code from events)"""
register("b14_resolve_customers", f"""
select k.key_id, k.code, c.id as customer_id, c.name, c.loyalty_points, c.loyalty_tier,
       case when c.id is not null then cast(coalesce(n.total_bills, 0) as bigint) end as total_bills
from {_CKEYS} k left join customers c on cast(c.id as varchar) = k.code or c.phone = k.code or c.email = k.code
left join (select customer_id, count(*) as total_bills from bills where status = 'completed' group by 1) n
  on n.customer_id = c.id""")(lambda t: B.resolve_customers(t, W.customer_keys(t.raw("events"))))

register("b15_resolve_payments", """
with pb as (select p.*, b.bill_number, b.net_amount as bill_amount from payments p join bills b on p.bill_id = b.id),
keys as (select o_orderkey as key_id, case when o_orderkey % 2 = 0 then concat('pay_', cast(o_orderkey as varchar))
         else cast(o_orderkey as varchar) end as code from orders),
hits as (select k.key_id, k.code, pb.id as payment_id, row_number() over (partition by k.key_id
           order by case when cast(pb.id as varchar) = k.code then 0 else 1 end, pb.created_at, pb.id) as rn
         from keys k join pb on cast(pb.id as varchar) = k.code or pb.gateway_transaction_id = k.code)
select k.key_id, k.code, h.payment_id, pb.bill_id, pb.bill_number, pb.amount, pb.method, pb.status, pb.bill_amount
from keys k left join hits h on h.key_id = k.key_id and h.rn = 1 left join pb on pb.id = h.payment_id""")(
    lambda t: B.resolve_payments(t, W.payment_keys(t.raw("orders"))))

register("b16_resolve_bills", """
select k.key_id, k.code, b.id as bill_id, b.bill_number, b.net_amount, b.status, b.customer_id,
       c.name as customer_name
from (select id as key_id, case when id % 2 = 0 then bill_number else cast(id as varchar) end as code from bills) k
left join bills b on cast(b.id as varchar) = k.code or b.bill_number = k.code
left join customers c on b.customer_id = c.id""")(lambda t: B.resolve_bills(t, W.bill_keys(t.bills)))

register("b17_customer_loyalty", """
with step(tier, goal) as (values ('bronze', 1000), ('silver', 5000), ('gold', 10000))
select id, name, loyalty_points, loyalty_tier, total_purchases, cast(coalesce(goal - loyalty_points, 0) as int) as points_to_next_tier
from customers left join step on tier = loyalty_tier""")(B.customer_loyalty)
register("b18_user_profiles", """
select u.id, u.name, u.email, u.role, u.department_id, d.name as department_name
from users u left join departments d on u.department_id = d.id""")(B.user_profiles)
register("b21_recent_bills", f"""
with {_NAMES},
newest as (select *, row_number() over (order by created_at desc, id) as place from bills where status = 'completed')
select id, bill_number, net_amount, payment_method, status, (select of from buyer)[customer_id] as customer_name, created_at
from newest where place <= 10""")(B.recent_bills)
register("b22_bills_presentation", """
select b.id, b.bill_number, b.customer_id, c.name as customer_name, b.total_amount, b.discount_amount,
       b.tax_amount, b.net_amount, b.payment_method, b.status, b.cashier_id, u.name as cashier_name, b.created_at,
       coalesce(c.name, 'Walk-in') as customer_label,
       case when b.status = 'completed' then 'success' else 'warning' end as status_badge
from bills b left join customers c on b.customer_id = c.id left join users u on b.cashier_id = u.id
order by b.created_at desc, b.id limit 20""")(lambda t: B.with_presentation(B.bills_list(t)[0]))

# ------------------------------------------------------------------ D: ledger
from tillroll.operators import carts as K  # noqa: E402
from tillroll.operators import integrity as I  # noqa: E402
from tillroll.operators import ledger as D  # noqa: E402

_PRICED = """(select bi.bill_id, bi.product_id, bi.quantity, bi.discount, p.price as unit_price, p.tax_rate,
   cast(p.price * bi.quantity - bi.discount as decimal(18,2)) as net_price,
   cast(cast(p.price * bi.quantity - bi.discount as decimal(18,2)) * p.tax_rate * cast(0.01 as decimal(3,2))
        as decimal(24,6)) as tax_exact
 from bill_items bi join products p on bi.product_id = p.id)"""
register("d01_price_lines", f"""
select bill_id, product_id, quantity, discount, unit_price, tax_rate, net_price, tax_exact,
       cast(round(tax_exact, 2) as decimal(18,2)) as tax_amount,
       cast(round(net_price + tax_exact, 2) as decimal(18,2)) as total_price from {_PRICED} x""")(
    lambda t: D.price_lines(W.order_lines(t.bill_items), t.products))

_TOTALS = f"""
select per.bill_id, cast(per.n as decimal(18,2)) as total_amount, cast(round(per.tx, 2) as decimal(18,2)) as tax_amount,
       cast(b.discount_amount as decimal(18,2)) as discount_amount,
       cast(round(per.n + per.tx - b.discount_amount, 2) as decimal(18,2)) as net_amount,
       cast(per.lt as decimal(18,2)) as line_tax_sum, cast(per.lt - round(per.tx, 2) as decimal(18,2)) as tax_difference
from (select bill_id, sum(net_price) as n, sum(tax_exact) as tx, sum(round(tax_exact, 2)) as lt
      from {_PRICED} x group by bill_id) per join bills b on b.id = per.bill_id"""


def _totals(t):
    return D.bill_totals(D.price_lines(W.order_lines(t.bill_items), t.products), t.bills)


register("d02_bill_totals", _TOTALS)(_totals)
register("d02_tax_reconciliation", f"""
select bill_id, tax_amount, line_tax_sum, tax_difference from ({_TOTALS}) y where tax_difference <> 0""")(
    lambda t: D.tax_reconciliation(_totals(t)))

register("d03_bill_numbers", """
select id, created_at, seq, concat('BILL-', strftime(created_at, '%Y%m%d'), '-',
       lpad(cast(seq as varchar), cast(greatest(4, length(cast(seq as varchar))) as int), '0')) as bill_number
from (select id, created_at, row_number() over (order by created_at, id) as seq from bills) x""")(
    lambda t: D.bill_numbers(t.bills))

register("d05_apply_sales", """
select p.id, p.stock_quantity as previous_stock, cast(coalesce(s.sold, 0) as bigint) as sold,
       cast(p.stock_quantity - coalesce(s.sold, 0) as int) as stock_quantity, s.sold is not null as changed
from products p left join (select bi.product_id, sum(bi.quantity) as sold from bill_items bi
  join bills b on b.id = bi.bill_id where b.status = 'completed' group by 1) s on s.product_id = p.id""")(
    lambda t: D.apply_sales(t.products, t.bill_items.join(
        t.bills.filter("status = 'completed'").select(F.col("id").alias("bill_id")), "bill_id", "left_semi")))

_TIER = "case when {p} >= 10000 then 'platinum' when {p} >= 5000 then 'gold' when {p} >= 1000 then 'silver' " \
        "else 'bronze' end"
register("d06_accrue_loyalty", f"""
select c.id, cast(coalesce(x.pts, 0) as bigint) as points_added,
       cast(c.loyalty_points + coalesce(x.pts, 0) as int) as loyalty_points,
       cast(c.total_purchases + coalesce(x.spent, 0) as decimal(14,2)) as total_purchases,
       case when x.pts is not null then {_TIER.format(p='(c.loyalty_points + x.pts)')} else c.loyalty_tier end
         as loyalty_tier,
       x.pts is not null as changed
from customers c left join (select customer_id, sum(cast(floor(net_amount / 10) as bigint)) as pts,
  sum(net_amount) as spent from bills where status = 'completed' and customer_id is not null group by 1) x
  on x.customer_id = c.id""")(
    lambda t: D.accrue_loyalty(t.customers, t.bills.filter("status = 'completed'")))

register("d07_stale_tiers", f"""
select id, loyalty_points, loyalty_tier, {_TIER.format(p='loyalty_points')} as expected_tier from customers
where loyalty_tier <> {_TIER.format(p='loyalty_points')}""")(lambda t: D.stale_tiers(t.customers))

_HIT = "(select * from bills where status in ('refunded', 'voided') and status <> 'voided')"
register("d08_void_bills", f"""
select id, status as previous_status, 'voided' as status from {_HIT} h""")(
    lambda t: D.void_bills(t, W.void_requests(t.bills))[0])
register("d08_void_decisions", """
with asked as (select id as bill_id from bills where status in ('refunded', 'voided')
               union select -id from bills where status in ('refunded', 'voided') and id % 10 = 0)
select bill_id, case when bill_id < 0 then 'bill_not_found'
                     when bill_id in (select id from bills where status = 'voided') then 'bill_already_voided' end as reject_reason
from asked""")(lambda t: D.void_decisions(t, W.with_unknown_bills(W.void_requests(t.bills))))
register("d08_void_stock", f"""
select p.id, p.stock_quantity as previous_stock, cast(r.restored as bigint) as restored,
       cast(p.stock_quantity + r.restored as int) as stock_quantity
from products p join (select product_id, sum(quantity) as restored from bill_items
  where bill_id in (select id from {_HIT} h) group by 1) r on r.product_id = p.id""")(
    lambda t: D.void_bills(t, W.void_requests(t.bills))[1])
register("d08_void_customers", f"""
select c.id, per.pr as points_removed, cast(greatest(0, c.loyalty_points - per.pr) as int) as loyalty_points,
       cast(greatest(0, c.total_purchases - per.sr) as decimal(14,2)) as total_purchases
from customers c join (select customer_id, sum(cast(floor(net_amount / 10) as bigint)) as pr, sum(net_amount) as sr
  from {_HIT} h where customer_id is not null group by 1) per on per.customer_id = c.id""")(
    lambda t: D.void_bills(t, W.void_requests(t.bills))[2])

_RETURN_QUANTITY = "case when l_linenumber = 7 then cast(l_quantity as int) + 1 else cast(ceil(l_quantity / 2) as int) end"


def _valid(quantity: str = _RETURN_QUANTITY) -> str:
    return f"""
with req0 as (select l_orderkey as request_id, l_orderkey as bill_id, l_partkey as product_id,
   {quantity} as quantity,
   l_shipdate as created_at from lineitem where l_returnflag = 'R'),
req as (select request_id, bill_id, product_id, sum(quantity) as quantity, min(created_at) as created_at,
   min(quantity) as min_q, bool_or(quantity is null) as no_q from req0 group by 1, 2, 3),
sold as (select bill_id, product_id, sum(quantity) as sq, sum(total_price) as st from bill_items group by 1, 2),
lines as (select r.request_id, r.bill_id, r.product_id, cast(r.quantity as int) as quantity, r.created_at,
   case when r.no_q then 'quantity_missing' when b.id is null then 'bill_not_found' when b.status <> 'completed' then 'bill_not_returnable'
        when s.sq is null then 'product_not_on_bill' when r.min_q <= 0 then 'quantity_not_positive'
        when r.quantity > s.sq then 'quantity_exceeds_sold' end as line_reject,
   cast(cast((cast(s.st * 100 as bigint) * r.quantity * 20000 + s.sq) // (2 * s.sq) as decimal(24,0))
        * cast(0.000001 as decimal(7,6)) as decimal(24,6)) as amt
   from req r left join bills b on b.id = r.bill_id left join sold s on s.bill_id = r.bill_id and s.product_id = r.product_id),
per as (select request_id, bill_id, min(line_reject) as req_reject, min(created_at) as first_at from lines group by 1, 2),
ranked as (select request_id, coalesce(req_reject, case when row_number() over (partition by bill_id, req_reject is null
   order by first_at, request_id) > 1 then 'bill_already_returned' end) as reject_reason from per),
validated as (select l.request_id, l.bill_id, l.product_id, l.quantity, l.created_at, k.reject_reason,
   case when k.reject_reason is null then case when l.line_reject is null then l.amt end end as amount_exact
   from lines l join ranked k on k.request_id = l.request_id)"""


_VALID = _valid()


def _validated(t):
    return D.validate_returns(t, W.return_requests(t.raw("lineitem")))


register("d09_validate_returns", _VALID + "\nselect * from validated")(_validated)
# Every fifth request lacks quantities, amounts or gateway ids.
_GAPS = f"case when l_orderkey % 5 <> 0 then {_RETURN_QUANTITY} end"


def _validated_gaps(t):
    return D.validate_returns(t, W.with_gaps(W.return_requests(t.raw("lineitem")), "quantity"))


register("d09_incomplete_returns", _valid(_GAPS) + "\nselect * from validated")(_validated_gaps)
register("d11_incomplete_returns_stock", _valid(_GAPS) + """
select p.id, p.stock_quantity as previous_stock, cast(r.restored as bigint) as restored,
       cast(p.stock_quantity + r.restored as int) as stock_quantity
from products p join (select product_id, sum(quantity) as restored from validated where reject_reason is null
  group by 1) r on r.product_id = p.id""")(lambda t: D.apply_returns(t, _validated_gaps(t))[1])
register("d10_return_amounts", _VALID + """
select request_id, bill_id, cast(round(sum(amount_exact), 2) as decimal(18,2)) as return_amount,
       cast(sum(quantity) as bigint) as items_returned, min(created_at) as created_at
from validated where reject_reason is null group by 1, 2""")(lambda t: D.return_amounts(_validated(t)))
register("d11_apply_returns_stock", _VALID + """
select p.id, p.stock_quantity as previous_stock, cast(r.restored as bigint) as restored,
       cast(p.stock_quantity + r.restored as int) as stock_quantity
from products p join (select product_id, sum(quantity) as restored from validated where reject_reason is null
  group by 1) r on r.product_id = p.id""")(lambda t: D.apply_returns(t, _validated(t))[1])
register("a04_return_items", _VALID + """
select request_id as id, bill_id, product_id, quantity from validated where reject_reason is null""")(
    lambda t: D.return_items(D.apply_returns(t, _validated(t))[0]))

def _stored_products(t, root=None):
    """Products of a store after three batches of sales, each written back to the files that hold its products."""
    from tillroll.streaming.sinks import scratch
    from tillroll.streaming.store import Store
    store = Store(t.spark, scratch(t.spark, "a05-sales"))
    apply.create(store, t, ["products", "customers"])
    for k in range(3):
        bills = t.bills.filter((F.col("id") % 3 == k) & (F.col("status") == "completed"))
        apply.sales(store, t.bill_items.join(bills.select(F.col("id").alias("bill_id")), "bill_id", "left_semi"), bills, batch=k)
    return store


register("a05_stock_after_sales", """
select p.id, cast(p.stock_quantity - coalesce(s.sold, 0) as int) as stock_quantity
from products p left join (select i.product_id, sum(i.quantity) as sold from bill_items i join bills b on b.id = i.bill_id
  where b.status = 'completed' group by 1) s on s.product_id = p.id""")(
    lambda t: _stored_products(t).read("products").select("id", "stock_quantity"))


def _applied_voids(t):
    from tillroll.streaming.sinks import scratch
    from tillroll.streaming.store import Store
    store = Store(t.spark, scratch(t.spark, "d08-voids"))
    apply.create(store, t, ["products", "customers", "bills", "bill_items", "returns"])
    apply.voids(store, W.void_requests(t.bills), batch=0)
    return store


register("d08_applied_bills", f"""
select id, case when id in (select id from {_HIT} h) then 'voided' else status end as status from bills""")(
    lambda t: _applied_voids(t).read("bills").select("id", "status"))

register("d12a_stock_ledger", """
select a.id, a.product_id, a.created_at, a.adjustment, a.type,
       cast(p.stock_quantity + coalesce(sum(a.adjustment) over (partition by a.product_id order by a.created_at, a.id
            rows between unbounded preceding and 1 preceding), 0) as bigint) as previous_quantity,
       cast(p.stock_quantity + sum(a.adjustment) over (partition by a.product_id order by a.created_at, a.id
            rows between unbounded preceding and current row) as bigint) as new_quantity
from stock_adjustments a join products p on p.id = a.product_id""")(lambda t: D.stock_ledger(t))

register("d12a_ledger_check", """
with kept as (select a.id, a.product_id, a.created_at, a.adjustment, p.stock_quantity
                + sum(a.adjustment) over (partition by a.product_id order by a.created_at, a.id) as bal
              from stock_adjustments a join products p on p.id = a.product_id),
stored as (select id, product_id, created_at, adjustment,
             bal - adjustment + (case when id % 31 = 0 then 1 else 0 end) + (case when id % 37 = 0 then 2 else 0 end) as prev,
             bal + (case when id % 37 = 0 then 2 else 0 end) as new from kept),
seen as (select *, lag(new) over (partition by product_id order by created_at, id) as prior from stored)
select id, product_id, created_at, cast(new - prev - adjustment as bigint) as sum_error,
       cast(coalesce(prev - prior, 0) as bigint) as unaudited_movement
from seen where new - prev - adjustment <> 0 or coalesce(prev - prior, 0) <> 0""")(
    lambda t: D.ledger_gaps(W.stored_ledger(D.stock_ledger(t))))

register("d12a_explained_gaps", """
with moves as (select i.product_id, b.created_at, -cast(sum(i.quantity) as bigint) as moved
               from bill_items i join bills b on b.id = i.bill_id where b.status <> 'voided' group by 1, 2
               union all select product_id, created_at, quantity from returns),
kept as (select a.id, a.product_id, a.created_at, a.adjustment, p.stock_quantity
                + sum(a.adjustment) over (partition by a.product_id order by a.created_at, a.id) as bal
         from stock_adjustments a join products p on p.id = a.product_id),
line as (select id, product_id, created_at, adjustment, bal, 0 as moved, 1 as kind from kept
         union all select null, product_id, created_at, null, null, moved, 0 from moves),
summed as (select *, sum(moved) over (partition by product_id order by created_at, kind, id) as total from line),
stored as (select id, product_id, created_at, total, bal - adjustment + total + (case when id % 31 = 0 then 1 else 0 end)
             + (case when id % 37 = 0 then 2 else 0 end) as prev, bal + total + (case when id % 37 = 0 then 2 else 0 end) as new
           from summed where kind = 1),
seen as (select *, lag(new) over w as prior, lag(total) over w as before from stored
         window w as (partition by product_id order by created_at, id))
select id, product_id, created_at, cast(prev - prior as bigint) as gap, cast(total - before as bigint) as explained,
       cast(prev - prior - (total - before) as bigint) as unexplained
from seen where prior is not null and (prev <> prior or prev - prior <> total - before)""")(
    lambda t: D.explained_gaps(W.audited_ledger(D.stock_ledger(t), D.stock_movements(t)), D.stock_movements(t)))

_PAYREQ = """(select id as request_id, id as bill_id, net_amount as amount, payment_method as method,
   created_at + interval '1' hour as created_at, status from bills where status in ('pending', 'voided'))"""
register("d14_record_payments", f"""
select request_id as id, bill_id, cast(amount as decimal(12,2)) as amount, method, 'completed' as status, created_at
from {_PAYREQ} r where method in ('cash', 'card', 'upi', 'wallet')""")(
    lambda t: D.record_payments(t, W.payment_requests(t.bills))[0])
register("d14_record_payments_fixed", f"""
select request_id as id, bill_id, cast(amount as decimal(12,2)) as amount, method, 'completed' as status, created_at
from {_PAYREQ} r where method in ('cash', 'card', 'upi', 'wallet') and status in ('pending', 'completed')""")(
    lambda t: D.record_payments(t, W.payment_requests(t.bills), fixed=True)[0])
register("d14_payment_decisions", f"""
with asked as (select request_id, bill_id, method, status from {_PAYREQ} r
               union all select -request_id, -bill_id, method, null from {_PAYREQ} r where bill_id % 10 = 0)
select request_id, bill_id, case when method not in ('cash', 'card', 'upi', 'wallet') then 'invalid_method'
       when bill_id < 0 then 'bill_not_found' when status = 'voided' then 'bill_not_payable' end as reject_reason
from asked""")(lambda t: D.payment_decisions(t, W.with_unknown_bills(W.payment_requests(t.bills)), fixed=True).select(
    "request_id", "bill_id", "reject_reason"))
register("d14_incomplete_payments", f"""
select request_id, bill_id, case when bill_id % 5 = 0 then 'amount_missing'
       when method not in ('cash', 'card', 'upi', 'wallet') then 'invalid_method' end as reject_reason
from {_PAYREQ} r""")(lambda t: D.payment_decisions(t, W.with_gaps(W.payment_requests(t.bills), "amount")).select(
    "request_id", "bill_id", "reject_reason"))
register("d14_bill_updates", f"""
select bill_id as id, 'completed' as status, method as payment_method
from {_PAYREQ} r where method in ('cash', 'card', 'upi', 'wallet')""")(
    lambda t: D.record_payments(t, W.payment_requests(t.bills))[1])

register("d15_match_payments", """
select r.request_id, r.bill_id, r.amount, b.net_amount, cast(round(r.amount * 100) as bigint) as amount_minor,
       case when b.status <> 'pending' then 'bill_not_pending' when abs(r.amount - b.net_amount) > 0.01
            then 'amount_mismatch' end as reject_reason
from (select id as request_id, id as bill_id,
      cast(net_amount + cast(id % 3 as decimal(3,0)) * cast(0.01 as decimal(3,2)) as decimal(12,2)) as amount
      from bills) r left join bills b on b.id = r.bill_id""")(
    lambda t: D.match_payments(t, W.payment_verifications(t.bills)))

register("d15_incomplete_verifications", """
select r.request_id, r.bill_id, r.amount, b.net_amount, cast(round(r.amount * 100) as bigint) as amount_minor,
       case when r.amount is null then 'amount_missing' when b.status <> 'pending' then 'bill_not_pending'
            when abs(r.amount - b.net_amount) > 0.01 then 'amount_mismatch' end as reject_reason
from (select id as request_id, id as bill_id, case when id % 5 <> 0 then
      cast(net_amount + cast(id % 3 as decimal(3,0)) * cast(0.01 as decimal(3,2)) as decimal(12,2)) end as amount
      from bills) r left join bills b on b.id = r.bill_id""")(
    lambda t: D.match_payments(t, W.with_gaps(W.payment_verifications(t.bills), "amount")))

register("d17_confirm_gateway_payments", """
select id as bill_id, net_amount as amount, 'razorpay' as method, 'completed' as status,
       concat('pay_', cast(id as varchar)) as gateway_transaction_id, created_at + interval '1' hour as created_at
from bills where status = 'pending' and payment_method = 'razorpay'""")(
    lambda t: D.confirm_gateway_payments(t, W.gateway_confirmations(t.bills))[0])

register("d17_gateway_rejects", """
select -id as bill_id, concat('pay_', cast(id as varchar)) as gateway_transaction_id, 'bill_not_found' as reject_reason
from bills where status = 'pending' and payment_method = 'razorpay' and id % 3 = 0""")(
    lambda t: D.gateway_rejects(t, W.with_unknown_bills(W.gateway_confirmations(t.bills), 3)).select(
        "bill_id", "gateway_transaction_id", "reject_reason"))

_GATEWAY = """(select id, net_amount, created_at + interval '1' hour as created_at,
  case when id % 5 <> 0 then concat('pay_', cast(id as varchar)) end as gateway_transaction_id
  from bills where status = 'pending' and payment_method = 'razorpay')"""
register("d17_incomplete_confirmations", f"""
select id as bill_id, net_amount as amount, 'razorpay' as method, 'completed' as status, gateway_transaction_id, created_at
from {_GATEWAY} g where gateway_transaction_id is not null""")(
    lambda t: D.confirm_gateway_payments(t, W.with_gaps(W.gateway_confirmations(t.bills), "gateway_transaction_id"))[0])
register("d17_incomplete_rejects", f"""
select id as bill_id, 'gateway_id_missing' as reject_reason from {_GATEWAY} g where gateway_transaction_id is null
union all
select -id, case when gateway_transaction_id is null then 'gateway_id_missing' else 'bill_not_found' end from {_GATEWAY} g where id % 3 = 0""")(
    lambda t: D.gateway_rejects(t, W.with_gaps(W.with_unknown_bills(W.gateway_confirmations(t.bills), 3),
                                               "gateway_transaction_id")).select("bill_id", "reject_reason"))

_REFREQ = """(select bill_id as request_id, bill_id as payment_id, cast(sum(return_amount) as decimal(12,2)) as amount,
   min(created_at) as created_at from returns group by bill_id)"""
register("d18_refund_payments", f"""
select r.request_id as id, p.bill_id, cast(-abs(coalesce(r.amount, p.amount)) as decimal(12,2)) as amount, p.method,
       'refunded' as status, p.gateway_transaction_id, r.created_at
from {_REFREQ} r join payments p on p.id = r.payment_id
where p.status = 'completed' and coalesce(r.amount, p.amount) > 0 and coalesce(r.amount, p.amount) <= p.amount""")(
    lambda t: D.refund_payments(t, W.refund_requests(t.returns))[0])
register("d18_refund_updates", f"""
select distinct r.payment_id as id, 'refunded' as status
from {_REFREQ} r join payments p on p.id = r.payment_id
where p.status = 'completed' and coalesce(r.amount, p.amount) > 0 and coalesce(r.amount, p.amount) <= p.amount""")(
    lambda t: D.refund_payments(t, W.refund_requests(t.returns))[1])
register("d18_refund_decisions", f"""
with r as (select *, 0 as again from {_REFREQ} x union all
           select request_id + 1000000000, payment_id, amount, created_at + interval 1 hour, 1 from {_REFREQ} y)
select r.request_id, r.payment_id,
  case when p.id is null then 'payment_not_found' when p.status <> 'completed' then 'payment_not_refundable'
       when coalesce(r.amount, p.amount) <= 0 then 'amount_not_positive'
       when coalesce(r.amount, p.amount) > p.amount then 'amount_exceeds_payment'
       when again = 1 then 'payment_already_refunded' end as reject_reason
from r left join payments p on p.id = r.payment_id""")(
    lambda t: D.refund_decisions(t, W.asked_twice(W.refund_requests(t.returns))).select(
        "request_id", "payment_id", "reject_reason"))
register("d18a_net_collections", """
select bill_id, method, cast(sum(amount) as decimal(18,2)) as net_collected, count(*) as payment_rows
from payments where status in ('completed', 'refunded') group by 1, 2""")(lambda t: D.net_collections(t.payments))

# ------------------------------------------------------------------ A2, D19–D27
register("a02_insert_absent", """
select n.* from (select event_id as id, concat('Customer#', cast(event_id as varchar)) as name,
   concat('c', cast(event_id as varchar), '@mail.example') as email,
   concat('+91-', lpad(cast(event_id as varchar), 10, '0')) as phone, 0 as loyalty_points, 'bronze' as loyalty_tier,
   cast(0 as decimal(14,2)) as total_purchases, true as is_active from events where event_type = 'signup') n
where not exists (select 1 from customers c where c.id = n.id)""")(
    lambda t: I.insert_absent(t.customers, W.new_customers(t.raw("events")), ["id"]))

register("d19_apply_patch", """
select c.id, c.name, coalesce(p.email, c.email) as email, c.phone, c.loyalty_points, c.loyalty_tier,
       c.total_purchases, c.is_active, coalesce(p.email is not null and p.email is distinct from c.email, false) as changed
from customers c left join (select user_id as id, arg_max(concat('u', cast(event_id as varchar), '@mail.example'),
  event_id) as email from events where event_type = 'signup' group by user_id) p on p.id = c.id""")(
    lambda t: I.apply_patch(t.customers, W.customer_patches(t.raw("events")), "id", ["name", "email"])[0])

register("d20_soft_delete", """
select p.id, p.name, p.sku, p.barcode, p.price, p.tax_rate, p.stock_quantity, p.minimum_stock, p.unit, p.category,
       p.department_id, p.supplier_id, case when x.id is not null then false else p.is_active end as is_active,
       x.id is not null as changed
from products p left join (select distinct event_id as id from events where event_type = 'error') x on x.id = p.id""")(
    lambda t: I.soft_delete(t.products, W.product_deactivations(t.raw("events"))))

register("d21_deactivation_blocked", """
select d.id as department_id from departments d
where exists (select 1 from products p where p.department_id = d.id and p.is_active)""")(
    lambda t: I.department_deactivation(t.departments, t.products,
                                        t.departments.select(F.col("id").alias("department_id")))[1])
register("d21_deactivation_allowed", """
select d.id as department_id from departments d
where not exists (select 1 from products p where p.department_id = d.id and p.is_active)""")(
    lambda t: I.department_deactivation(t.departments, t.products,
                                        t.departments.select(F.col("id").alias("department_id")))[0])

_NEWP = """(select event_id as request_id, concat('New ', cast(event_id as varchar)) as name,
   concat('SKU', cast(floor(event_id / 4) as bigint)) as sku,
   case when event_id % 2 = 0 then concat('890', lpad(cast(event_id as varchar), 10, '0')) end as barcode,
   cast(floor(value) as decimal(12,2)) as price from events where event_type = 'purchase')"""
register("d22_unique_on_create", f"""
with f as (select n.*, sku in (select sku from products) as sku_held,
             coalesce(barcode in (select barcode from products where barcode is not null), false) as barcode_held
           from {_NEWP} n),
winner as (select sku, min(request_id) as won from f where not sku_held and not barcode_held group by sku)
select f.request_id, f.name, f.sku, f.barcode, f.price,
  case when sku_held then 'sku_exists' when f.request_id > winner.won then 'sku_repeated_in_batch'
       when barcode_held then 'barcode_exists' end as conflict
from f left join winner on winner.sku = f.sku""")(
    lambda t: I.unique_on_create(t.products, W.new_products(t.raw("events")), ["sku", "barcode"]))
register("d22b_product_rules", f"""
select request_id, name, sku, barcode, price,
  case when name is null or trim(name) = '' then 'name_required' when sku is null or trim(sku) = '' then 'sku_required'
       when price is null or price = 0 then 'price_required' end as reject_reason from {_NEWP} n""")(
    lambda t: I.product_rules(W.new_products(t.raw("events"))))

register("d23_check_constraints", """
select 'users' as table_name, 'role_valid' as rule, count(*) filter (where not (role in ('admin', 'manager', 'cashier'))) as violations from users
union all select 'products', 'price_non_negative', count(*) filter (where not (price >= 0)) from products
union all select 'products', 'tax_rate_0_100', count(*) filter (where not (tax_rate >= 0 and tax_rate <= 100)) from products
union all select 'products', 'stock_non_negative', count(*) filter (where not (stock_quantity >= 0)) from products
union all select 'customers', 'points_non_negative', count(*) filter (where not (loyalty_points >= 0)) from customers
union all select 'customers', 'tier_valid', count(*) filter (where not (loyalty_tier in ('bronze', 'silver', 'gold', 'platinum'))) from customers
union all select 'bills', 'total_non_negative', count(*) filter (where not (total_amount >= 0)) from bills
union all select 'bills', 'net_non_negative', count(*) filter (where not (net_amount >= 0)) from bills
union all select 'bills', 'method_valid', count(*) filter (where not (payment_method in ('cash', 'card', 'upi', 'wallet', 'credit', 'razorpay'))) from bills
union all select 'bills', 'status_valid', count(*) filter (where not (status in ('pending', 'completed', 'voided', 'refunded', 'partially_returned'))) from bills
union all select 'bill_items', 'quantity_positive', count(*) filter (where not (quantity > 0)) from bill_items
union all select 'payments', 'status_valid', count(*) filter (where not (status in ('pending', 'completed', 'failed', 'refunded'))) from payments
union all select 'stock_adjustments', 'type_valid', count(*) filter (where not (type in ('purchase', 'return', 'damage', 'manual', 'audit'))) from stock_adjustments
""")(lambda t: functools.reduce(DataFrame.unionByName, [I.check_constraints(t, n) for n in I.CHECKS]))

register("d23a_check_unique", """
select 'departments' as table_name, 'name' as column_name, cast(name as varchar) as value, count(*) as rows from departments where name is not null group by 3 having count(*) > 1
union all select 'users', 'email', email, count(*) from users where email is not null group by 3 having count(*) > 1
union all select 'products', 'sku', sku, count(*) from products where sku is not null group by 3 having count(*) > 1
union all select 'products', 'barcode', barcode, count(*) from products where barcode is not null group by 3 having count(*) > 1
union all select 'customers', 'email', email, count(*) from customers where email is not null group by 3 having count(*) > 1
union all select 'customers', 'phone', phone, count(*) from customers where phone is not null group by 3 having count(*) > 1
union all select 'bills', 'bill_number', bill_number, count(*) from bills where bill_number is not null group by 3 having count(*) > 1
""")(lambda t: functools.reduce(DataFrame.unionByName, [I.check_unique(t, n) for n in I.UNIQUE]))

register("d24_check_foreign_keys", " union all ".join(
    f"select '{c}' as table_name, '{col}' as column_name, '{p}' as parent_table, count(*) as orphans from {c} x "
    f"where x.{col} is not null and not exists (select 1 from {p} y where y.id = x.{col})"
    for c, col, p in I.FOREIGN_KEYS))(I.check_foreign_keys)

register("d26_fold_carts", """
with lines as (select a.cart_id, a.product_id, count(*) as quantity from cart_events a
  where a.action = 'add' and not exists (select 1 from cart_events r where r.action = 'remove'
    and r.cart_id = a.cart_id and r.product_id = a.product_id and (r.ts > a.ts or (r.ts = a.ts and r.id > a.id)))
  group by 1, 2)
select l.cart_id, count(*) as lines, cast(sum(l.quantity) as bigint) as units,
       cast(sum(p.price * l.quantity) as decimal(18,2)) as cart_total
from lines l join products p on p.id = l.product_id group by l.cart_id""")(
    lambda t: K.fold_carts(t.cart_events, t.products))
register("d27_last_login", """
select user_id as id, max(ts) as last_login from events group by user_id""")(
    lambda t: K.last_login(t.raw("events")))
register("d27_users_last_login", """
select u.id, u.email, cast((select max(e.ts) from events e where e.user_id = u.id) as timestamp) as last_login from users u""")(
    lambda t: K.record_logins(t.users, t.raw("events")).select("id", "email", "last_login"))

# ------------------------------------------------------------------ S: streaming twins
from tillroll.streaming import intake as SI  # noqa: E402
from tillroll.streaming import live as SL  # noqa: E402
from tillroll.streaming import stock as SK  # noqa: E402
from tillroll.streaming import windows as SV  # noqa: E402

register("s01_hourly_revenue_stream", """
select date_trunc('hour', created_at) as hour_start, count(*) as transactions,
       cast(sum(net_amount) as decimal(18,2)) as revenue from bills where status = 'completed' group by 1""")(
    lambda t: SL.hourly_revenue(t.spark, t.sf_dir))
register("s02_payment_mix_stream", """
select date_trunc('day', created_at) as day_start, payment_method, count(*) as count,
       cast(sum(net_amount) as decimal(18,2)) as amount from bills where status = 'completed' group by 1, 2""")(
    lambda t: SL.payment_mix(t.spark, t.sf_dir))
def _kept_windows(t, figure):
    """``figure`` over the bills as several micro-batches of files that each hold all times."""
    from tillroll.streaming.sinks import scratch
    root = scratch(t.spark, "s01-windows")
    return figure(SL.shuffled_bills_stream(t, f"{root}/bills"), root)


register("s01_hourly_revenue_late_rows", """
select date_trunc('hour', created_at) as hour_start, count(*) as transactions,
       cast(sum(net_amount) as decimal(18,2)) as revenue from bills where status = 'completed' group by 1""")(
    lambda t: _kept_windows(t, SV.hourly_revenue))
register("s02_payment_mix_late_rows", """
select date_trunc('day', created_at) as day_start, payment_method, count(*) as count,
       cast(sum(net_amount) as decimal(18,2)) as amount from bills where status = 'completed' group by 1, 2""")(
    lambda t: _kept_windows(t, SV.payment_mix))

register("s03_stock_balance_stream", """
with d as (select bi.product_id, -bi.quantity as delta from bill_items bi where bi.bill_id in (select id from bills)
           union all select bi.product_id, bi.quantity from bill_items bi join bills b on b.id = bi.bill_id
             where b.status = 'voided'
           union all select product_id, quantity from returns
           union all select product_id, adjustment from stock_adjustments),
agg as (select product_id, sum(delta) as delta from d group by 1)
select agg.product_id, cast(agg.delta as bigint) as delta, cast(p.stock_quantity + agg.delta as bigint) as balance,
       (p.stock_quantity > p.minimum_stock and p.stock_quantity + agg.delta <= p.minimum_stock) as low_stock_alert
from agg join products p on p.id = agg.product_id""")(lambda t: SL.stock_balance(t.spark, t.sf_dir, t))
def _stock_alerts(t):
    from tillroll.streaming.sinks import scratch
    root = scratch(t.spark, "s03-alerts")
    events = SK.event_files(SK.stock_events(t), f"{root}/events", 4)
    return SK.finish(SK.monitor(events, t.products, root)).read("alerts")


register("s03_low_stock_alerts", """
with b as (select id, created_at from bills where status <> 'voided'),
e as (select i.product_id, b.created_at, 0 as kind, i.bill_id as ref, -sum(i.quantity) as delta from bill_items i join b on b.id = i.bill_id group by all
      union all select product_id, created_at, 1, bill_id, sum(quantity) from returns group by all
      union all select product_id, created_at, 2, id, adjustment from stock_adjustments),
r as (select e.*, p.minimum_stock, p.stock_quantity + sum(delta) over (partition by e.product_id order by e.created_at, kind, ref
        rows unbounded preceding) as now from e join products p on p.id = e.product_id)
select product_id, created_at, kind, ref, cast(now as bigint) as balance from r where now - delta > minimum_stock and now <= minimum_stock""")(
    _stock_alerts)

register("s04_loyalty_stream", f"""
select c.id, cast(x.pts as bigint) as points_added, cast(c.loyalty_points + x.pts as int) as loyalty_points,
       cast(c.total_purchases + x.spent as decimal(14,2)) as total_purchases,
       {_TIER.format(p='(c.loyalty_points + x.pts)')} as loyalty_tier
from customers c join (select customer_id, sum(cast(floor(net_amount / 10) as bigint)) as pts,
  sum(net_amount) as spent from bills where status = 'completed' and customer_id is not null group by 1) x
  on x.customer_id = c.id""")(lambda t: SL.loyalty(t.spark, t.sf_dir, t))
register("s05_order_intake_stream", f"""
select y.* from ({_TOTALS}) y join bills b on b.id = y.bill_id
where b.payment_method in ('cash', 'card', 'upi', 'wallet', 'credit')""")(
    lambda t: SI.priced_rows(t.spark, SI.run_intake(t.spark, t)))

# ------------------------------------------------------------------ D4 (iterative; rows-only check)
register("d04_admit_orders")(lambda t: D.admit_orders(t, t.bills))

register("b03b_bulk_product_search", """
with terms as (select distinct w as term from (select unnest(string_split(lower(regexp_replace(name, '[0-9]+', '', 'g')), ' ')) as w
               from products) x where length(w) > 0),
hits as (select distinct t.term, p.id, p.name, p.sku, p.price from terms t join products p on p.is_active
         and (p.name ilike '%' || t.term || '%' or p.sku ilike '%' || t.term || '%' or p.barcode = t.term))
select * from (select term, id, name, sku, price, row_number() over (partition by term order by name, id) as rank
               from hits) y where rank <= 20""")(lambda t: B.bulk_product_search(t, B.name_words(t)))

register("b03b_typed_terms", """
with words as (select distinct w from (select unnest(string_split(lower(regexp_replace(name, '[0-9]+', '', 'g')), ' ')) as w
               from products) x where length(w) > 0),
skus as (select lower(sku) as s from products),
terms as (select w as term from words union select s from skus
          union select '_' || substr(s, 2, 3) || '%' || right(s, 2) from skus
          union select left(w, 2) || '%' || right(w, 1) from words union select repeat('_', length(w)) from words),
hits as (select t.term, p.id, p.name, p.sku, p.price from terms t join products p on p.is_active
         and (p.name ilike '%' || t.term || '%' or p.sku ilike '%' || t.term || '%' or p.barcode = t.term))
select * from (select term, id, name, sku, price, row_number() over (partition by term order by name, id) as rank
               from hits) y where rank <= 20""")(lambda t: B.bulk_product_search(t, B.typed_terms(t)))

# The model's CHECKs forbid negative totals: the intake refuses such orders, as the checkout does.
_REFUSED_REQUESTS = f"""
with counted as (select bill_id, count(*) as n from bill_items group by bill_id),
judged as (select b.id, coalesce(c.n, 0) as n, b.payment_method from bills b left join counted c on c.bill_id = b.id)
select id as request_id, case when n = 0 then 'items_required' else 'invalid_payment_method' end as reject_reason
from judged where n = 0 or payment_method = 'razorpay'
union all
select y.bill_id, 'negative_total' from ({_TOTALS}) y join bills b on b.id = y.bill_id
where b.payment_method <> 'razorpay' and (y.net_amount < 0 or y.total_amount < 0)
union all
select null, 'malformed_json' from bills where id % 97 = 0"""
register("a03_order_request_rejects", _REFUSED_REQUESTS)(lambda t: SI.parse_and_check(t.spark, t))
register("s05_order_intake_rejects", _REFUSED_REQUESTS)(
    lambda t: SI.committed_rows(t.spark, SI.run_intake(t.spark, t), "rejects"))

# ------------------------------------------------------------------ quirk twins and variants
register("q06_net_sales", f"""
select count(*) as total_bills, {S0('b.net_amount')} as gross_revenue, {S0('r.ret')} as returned_amount,
       {S0('b.net_amount - coalesce(r.ret, 0)')} as net_sales
from bills b left join (select bill_id, sum(return_amount) as ret from returns group by 1) r on r.bill_id = b.id
where b.created_at between timestamp '{START} 00:00:00' and timestamp '{END} 00:00:00'
  and b.status in ('completed', 'partially_returned')""")(lambda t: C.net_sales(t, START, END))

register("q07_void_stock_fixed", f"""
with hit as {_HIT},
sold as (select bill_id, product_id, sum(quantity) as sold from bill_items where bill_id in (select id from hit)
         group by 1, 2),
back as (select bill_id, product_id, sum(quantity) as ret from returns where bill_id in (select id from hit)
         group by 1, 2),
per as (select s.product_id, sum(greatest(0, s.sold - coalesce(b.ret, 0))) as restored from sold s
        left join back b on b.bill_id = s.bill_id and b.product_id = s.product_id group by 1)
select p.id, p.stock_quantity as previous_stock, cast(per.restored as bigint) as restored,
       cast(p.stock_quantity + per.restored as int) as stock_quantity
from products p join per on per.product_id = p.id""")(
    lambda t: D.void_bills_fixed(t, W.void_requests(t.bills)))

register("d22a_product_defaults", f"""
select request_id, name, sku, barcode, price, cast(0 as decimal(5,2)) as tax_rate, 0 as stock_quantity,
       5 as minimum_stock, 'piece' as unit, true as is_active from {_NEWP} n""")(
    lambda t: I.with_defaults(W.new_products(t.raw("events")), I.PRODUCT_DEFAULTS,
                              {"tax_rate": "decimal(5,2)", "stock_quantity": "int", "minimum_stock": "int"}))

register("d25_touch_updated_at", f"""
select c.id, coalesce(p.email, c.email) as email,
       coalesce(p.email is not null and p.email is distinct from c.email, false) as changed,
       case when p.id is not null then timestamp '{AS_OF}' end as updated_at
from customers c left join (select user_id as id, arg_max(concat('u', cast(event_id as varchar), '@mail.example'),
  event_id) as email from events where event_type = 'signup' group by user_id) p on p.id = c.id""")(
    lambda t: I.apply_patch(t.customers, W.customer_patches(t.raw("events")), "id", ["name", "email"],
                            touch=F.lit(AS_OF).cast("timestamp_ntz"))[0].select("id", "email", "changed", "updated_at"))

register("c15_department_report_one", _C15 + " where id = 3")(
    lambda t: C.department_report(t, START, END, department_id=3))
register("c16_product_report_one", f"""
with moved as (select product_id as id, sum(quantity) as units, sum(total_price) as taken, sum(tax_amount) as tax
  from bill_items group by product_id)
select id, name, sku, category, cast(coalesce(units, 0) as bigint) as total_sold, cast(coalesce(taken, 0) as decimal(18,2)) as revenue,
       cast(coalesce(tax, 0) as decimal(18,2)) as tax_collected, stock_quantity as current_stock
from products left join moved using (id) where is_active and department_id = 3 order by revenue desc, id limit 20""")(lambda t: C.product_report(t, START, END, department_id=3))

_WKNOW = "created_at >= timestamp '2001-07-16 00:00:00' and created_at < timestamp '2001-07-23 00:00:00' " \
         "and status = 'completed'"
register("c10_weekly_by_day_current", f"""
select cast(created_at as date) as date, rpad(strftime(created_at, '%A'), 9, ' ') as day_name,
       count(*) as total_transactions, {S0('net_amount')} as total_revenue, {S0('tax_amount')} as total_tax
from bills where {_WKNOW} group by 1, 2 order by 1""")(lambda t: C.weekly_by_day(t, as_of=AS_OF))
register("c11_weekly_totals_current", f"""
select count(*) as total_transactions, {S0('net_amount')} as total_revenue, {S0('tax_amount')} as total_tax,
       {A0('net_amount')} as avg_transaction_value from bills where {_WKNOW}""")(
    lambda t: C.weekly_totals(t, as_of=AS_OF))

# S5 full path: admission against stock makes it iterative (rows-only check; see tests/test_checkout.py)
register("s05_checkout_stream")(lambda t: SI.checkout_bills(t.spark, t))

# D12 / D13 oracles: the sequential per-key clamp as a recursive CTE (depth = steps per key)
register("d12_adjust_stock", """
with recursive s as (
  select a.id, a.product_id, a.adjustment, a.type, a.adjusted_by, a.created_at, cast(p.stock_quantity as bigint) as open,
         row_number() over (partition by a.product_id order by a.created_at, a.id) as n
  from stock_adjustments a join products p on p.id = a.product_id),
r as (
  select id, product_id, n, open as before, case when open + adjustment >= 0 then open + adjustment else open end as after,
         open + adjustment >= 0 as accepted
  from s where n = 1
  union all
  select s.id, s.product_id, s.n, r.after,
         case when r.after + s.adjustment >= 0 then r.after + s.adjustment else r.after end,
         r.after + s.adjustment >= 0
  from r join s on s.product_id = r.product_id and s.n = r.n + 1)
select s.id, s.product_id, s.adjustment, coalesce(s.type, 'manual') as type, s.adjusted_by, s.created_at, r.accepted,
       cast(r.before as bigint) as previous_quantity,
       cast(case when r.accepted then r.after end as bigint) as new_quantity,
       case when not r.accepted then 'insufficient_stock' end as reject_reason
from s join r on r.id = s.id
union all
select id, product_id, adjustment, coalesce(type, 'manual'), adjusted_by, created_at, false, null, null, 'product_not_found'
from stock_adjustments where product_id not in (select id from products)""")(lambda t: D.adjust_stock(t))

register("d13_redeem_points", f"""
with recursive req as (
  select event_id as request_id, user_id as customer_id, cast(floor(value) * 100 as int) as points, ts as created_at
  from events where event_type = 'purchase'),
s as (
  select q.*, cast(c.loyalty_points as bigint) as open,
         row_number() over (partition by q.customer_id order by q.created_at, q.request_id) as n
  from req q join customers c on c.id = q.customer_id where q.points > 0),
r as (
  select request_id, customer_id, n, open as before, case when open >= points then open - points else open end as after,
         open >= points as accepted
  from s where n = 1
  union all
  select s.request_id, s.customer_id, s.n, r.after,
         case when r.after - s.points >= 0 then r.after - s.points else r.after end, r.after - s.points >= 0
  from r join s on s.customer_id = r.customer_id and s.n = r.n + 1)
select s.request_id, s.customer_id, s.points, s.created_at, r.accepted, cast(r.before as bigint) as balance_before,
       case when r.accepted then cast(s.points * 0.50 as decimal(12,2)) end as discount,
       case when r.accepted then {_TIER.format(p='r.after')} end as loyalty_tier,
       cast(case when r.accepted then r.after end as bigint) as loyalty_points,
       case when not r.accepted then 'insufficient_points' end as reject_reason
from s join r on r.request_id = s.request_id
union all
select request_id, customer_id, points, created_at, false, cast(null as bigint), cast(null as decimal(12,2)),
       cast(null as varchar), cast(null as bigint), 'points_not_positive'
from req where not (points > 0) or points is null
union all
select request_id, customer_id, points, created_at, false, null, null, null, null, 'customer_not_found'
from req where points > 0 and customer_id not in (select id from customers)""")(
    lambda t: D.redeem_points(t, W.redemption_requests(t.raw("events"))))

_NEWC = """(select event_id as id, concat('Customer#', cast(event_id as varchar)) as name,
   concat('c', cast(event_id as varchar), '@mail.example') as email,
   concat('+91-', lpad(cast(event_id as varchar), 10, '0')) as phone from events where event_type = 'signup')"""
register("d22_unique_customers", f"""
select n.id, n.name, n.email, n.phone,
  case when exists (select 1 from customers c where c.phone = n.phone) then 'phone_exists'
       when row_number() over (partition by n.phone order by n.id) > 1 then 'phone_repeated_in_batch'
       when exists (select 1 from customers c where c.email = n.email) then 'email_exists'
       when row_number() over (partition by n.email order by n.id) > 1 then 'email_repeated_in_batch'
  end as conflict
from {_NEWC} n""")(
    lambda t: I.unique_on_create(t.customers, W.new_customers(t.raw("events")).select("id", "name", "email", "phone"),
                                 ["phone", "email"], id_col="id"))
register("d22b_customer_rules", f"""
select id, name, email, phone,
  case when name is null or trim(name) = '' then 'name_required'
       when phone is null or trim(phone) = '' then 'phone_required' end as reject_reason from {_NEWC} n""")(
    lambda t: I.customer_rules(W.new_customers(t.raw("events")).select("id", "name", "email", "phone")))


# ------------------------------------------------------------------ rules, uniqueness and patches of the other tables
_NEWD = """(select -id - 1 as request_id, name from departments union all
   select event_id, case when event_id % 11 = 0 then ' ' else concat('Department ', cast(event_id % 50 as varchar)) end
   from events where event_type = 'signup')"""
_NEWU = """(select event_id as request_id, case when event_id % 13 <> 0 then concat('User ', cast(event_id as varchar)) end as name,
   case when event_id % 17 <> 0 then case when event_id % 2 = 1
     then upper(concat('user', cast(event_id % 300 as varchar), '@store.example'))
     else concat('user', cast(event_id % 300 as varchar), '@store.example') end end as email,
   case event_id % 4 when 0 then 'cashier' when 1 then 'manager' when 2 then 'boss' end as role
   from events where event_type = 'error')"""


def _new_departments(t):
    return W.new_departments(t.departments, t.raw("events"))


register("d22_unique_departments", f"""
select n.request_id, n.name, case when n.name in (select name from departments) then 'name_exists'
       when row_number() over (partition by n.name order by n.request_id) > 1 then 'name_repeated_in_batch' end as conflict
from {_NEWD} n""")(lambda t: I.unique_on_create(t.departments, _new_departments(t), ["name"]))
register("d22b_department_rules", f"""
select request_id, name, case when name is null or trim(name) = '' then 'name_required' end as reject_reason
from {_NEWD} n""")(lambda t: I.department_rules(_new_departments(t)))
register("d22_unique_users", f"""
select n.request_id, n.name, n.email, n.role, case when n.email is null then null
       when lower(n.email) in (select lower(email) from users) then 'email_exists'
       when row_number() over (partition by lower(n.email) order by n.request_id) > 1 then 'email_repeated_in_batch' end as conflict
from {_NEWU} n""")(lambda t: I.unique_on_create(t.users, W.new_users(t.raw("events")), ["email"], normalise={"email": F.lower}))
register("d22b_user_rules", f"""
select request_id, name, email, role, case when name is null or trim(name) = '' then 'name_required'
       when email is null or trim(email) = '' then 'email_required'
       when role is null or role not in ('admin', 'manager', 'cashier') then 'invalid_role' end as reject_reason
from {_NEWU} n""")(lambda t: I.user_rules(W.new_users(t.raw("events"))))
register("d22a_customer_defaults", f"""
select id, name, 0 as loyalty_points, 'bronze' as loyalty_tier, cast(0 as decimal(14,2)) as total_purchases, true as is_active
from {_NEWC} n""")(lambda t: I.with_defaults(W.new_customers(t.raw("events")).select("id", "name"), I.CUSTOMER_DEFAULTS,
                                             {"loyalty_points": "int", "total_purchases": "decimal(14,2)"}))
register("d19_patch_departments", """
select d.id, coalesce(p.description, d.description) as description,
       coalesce(p.description is not null and p.description is distinct from d.description, false) as changed
from departments d left join (select event_id % 30 as id,
    arg_max(concat('About ', cast(event_id as varchar)), event_id) filter (where event_id % 3 <> 0) as description
  from events where event_type = 'signup' group by 1) p on p.id = d.id""")(
    lambda t: I.apply_patch(t.departments, W.department_patches(t.raw("events")), "id", ["description"])[0].select(
        "id", "description", "changed"))
register("d19_patch_departments_unknown", """
select distinct event_id % 30 as id from events where event_type = 'signup' and event_id % 30 not in (select id from departments)""")(
    lambda t: I.apply_patch(t.departments, W.department_patches(t.raw("events")), "id", ["description"])[1].select("id"))
register("d19_patch_products", """
select p.id, coalesce(x.price, p.price) as price, coalesce(x.minimum_stock, p.minimum_stock) as minimum_stock,
       coalesce(x.price <> p.price, false) or coalesce(x.minimum_stock <> p.minimum_stock, false) as changed
from products p left join (select event_id % 500 as id,
    arg_max(cast(floor(value) as decimal(12,2)), event_id) filter (where event_id % 2 = 0) as price,
    arg_max(cast(event_id % 40 as int), event_id) filter (where event_id % 3 = 0) as minimum_stock
  from events where event_type = 'view' group by 1) x on x.id = p.id""")(
    lambda t: I.apply_patch(t.products, W.product_patches(t.raw("events")), "id", ["price", "minimum_stock"])[0].select(
        "id", "price", "minimum_stock", "changed"))
register("d19_patch_users", """
select u.id, coalesce(x.role, u.role) as role, coalesce(x.role <> u.role, false) as changed
from users u left join (select event_id % 100 as id,
    arg_max(case event_id % 5 when 0 then 'manager' else 'admin' end, event_id) filter (where event_id % 5 <= 1) as role
  from events where event_type = 'click' group by 1) x on x.id = u.id""")(
    lambda t: I.apply_patch(t.users, W.user_patches(t.raw("events")), "id", ["role"])[0].select("id", "role", "changed"))


# ------------------------------------------------------------------ checks on inputs that hold faults
register("b02_products_list_one_department", _PRODUCT_LIST.format(
    where="p.is_active = true and p.department_id = 3", limit=20, offset=0))(lambda t: B.products_list(t, department_id=3)[0])
register("d07_stale_tiers_found", f"""
with c as (select id, loyalty_tier, case when id % 3 = 0 then loyalty_points + 1500 else loyalty_points end as loyalty_points from customers)
select id, loyalty_points, loyalty_tier, {_TIER.format(p='loyalty_points')} as expected_tier from c
where loyalty_tier <> {_TIER.format(p='loyalty_points')}""")(lambda t: D.stale_tiers(W.points_without_tiers(t.customers)))
register("d23a_check_unique_found", """
with c as (select email, phone from customers union all select lower(email), phone from customers where id % 40 = 0)
select 'customers' as table_name, 'email' as column_name, email as value, count(*) as rows from c where email is not null group by 3 having count(*) > 1
union all select 'customers', 'phone', phone, count(*) from c where phone is not null group by 3 having count(*) > 1""")(
    lambda t: I.check_unique(t.with_tables(customers=W.with_copies(t.customers)), "customers"))
