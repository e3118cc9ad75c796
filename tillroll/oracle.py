"""DuckDB oracle: the model tables as CTEs over the driver's raw views.

``sql(body)`` prefixes a query body with the CTEs that define the model
tables (departments, users, suppliers, products, customers, bills, bill_items,
payments, returns, stock_adjustments, cart_events) so each oracle query is one
self-contained statement over the pre-registered raw tables.
"""

from __future__ import annotations

import re

# The mapping specification (same rules as sources/mapping.py).
_CTES = {
    "departments": """
select n_nationkey as id, n_name as name, concat('Region ', cast(n_regionkey as varchar(10))) as description,
n_nationkey % 10 as manager_id, n_nationkey % 12 <> 0 as is_active, cast('1994-01-01 00:00:00' as timestamp) as created_at from nation""",
    "users": """
select cast(s_suppkey as int) as id, concat('User ', s_name) as name, concat('user', cast(s_suppkey as varchar(20)), '@store.example') as email,
case when s_suppkey % 10 = 0 then 'admin' when s_suppkey % 10 in (1,2) then 'manager' else 'cashier' end as role,
case when s_suppkey % 10 = 0 then null else s_nationkey end as department_id, s_suppkey % 9 <> 8 as is_active from supplier""",
    "suppliers": """
select s_suppkey as id, s_name as name, concat('contact', cast(s_suppkey as varchar(20)), '@supplier.example') as contact_email,
s_acctbal >= 0 as is_active from supplier""",
    "products": """
select p_partkey as id, concat(p_name, ' ', cast(p_partkey as varchar(20))) as name, concat('SKU', cast(p_partkey as varchar(20))) as sku,
case when p_partkey % 13 = 0 then null else concat('890', lpad(cast(p_partkey as varchar(20)), 10, '0')) end as barcode,
cast(p_retailprice as decimal(12,2)) as price,
cast(case p_size % 4 when 0 then 0 when 1 then 5 when 2 then 12 else 18 end as decimal(5,2)) as tax_rate,
cast((p_partkey * 37) % 101 as int) as stock_quantity, p_size as minimum_stock, 'piece' as unit, p_type as category,
case when p_brand = 'Brand#25' then null else cast(substring(p_brand, 7) as int) - 1 end as department_id,
p_partkey % 10 as supplier_id, p_partkey % 20 <> 0 as is_active from part""",
    "customers": """
select id, name, case when id % 7 = 0 then null else concat('c', cast(id as varchar(20)), '@mail.example') end as email,
concat('+91-', lpad(cast(id as varchar(20)), 10, '0')) as phone, loyalty_points,
case when loyalty_points >= 10000 then 'platinum' when loyalty_points >= 5000 then 'gold' when loyalty_points >= 1000 then 'silver' else 'bronze' end as loyalty_tier,
cast(loyalty_points * 10 as decimal(14,2)) as total_purchases, id % 25 <> 0 as is_active
from (select c_custkey as id, c_name as name, cast(case when c_acctbal > 0 then floor(c_acctbal * 1.5) else 0 end as int) as loyalty_points from customer) x""",
    "bills": """
select id, concat('BILL-', strftime(created_at, '%Y%m%d'), '-', lpad(cast(id as varchar(20)), 9, '0')) as bill_number, customer_id, cashier_id,
cast(net_amount - tax_amount + discount_amount as decimal(12,2)) as total_amount, discount_amount, tax_amount, net_amount, payment_method, status, created_at
from (select o_orderkey as id, case when o_orderkey % 10 = 0 then null else o_custkey end as customer_id, cast(o_orderkey % 10 as int) as cashier_id,
cast(o_totalprice as decimal(12,2)) as net_amount,
cast(round(cast(o_totalprice as decimal(12,2)) * cast(0.05 as decimal(3,2)), 2) as decimal(12,2)) as tax_amount,
cast(round(cast(o_totalprice as decimal(12,2)) * cast(cast(o_orderkey % 5 as decimal(3,0)) * cast(0.01 as decimal(3,2)) as decimal(4,2)), 2) as decimal(12,2)) as discount_amount,
case o_orderpriority when '1-URGENT' then 'cash' when '2-HIGH' then 'card' when '3-MEDIUM' then 'upi' when '4-NOT SPECIFIED' then 'wallet'
else case when o_orderkey % 2 = 0 then 'credit' else 'razorpay' end end as payment_method,
case o_orderstatus when 'F' then 'completed' when 'O' then case when o_orderkey % 3 = 0 then 'pending' else 'completed' end
else case o_orderkey % 3 when 0 then 'voided' when 1 then 'partially_returned' else 'refunded' end end as status,
o_orderdate + interval '1' second * cast((o_orderkey * 7919) % 86400 as int) as created_at from orders) x""",
    "bill_items": """
select bill_id, product_id, quantity, unit_price, discount, tax_rate,
cast(round((unit_price * quantity - discount) * tax_rate * cast(0.01 as decimal(3,2)), 2) as decimal(12,2)) as tax_amount,
cast(unit_price * quantity - discount + round((unit_price * quantity - discount) * tax_rate * cast(0.01 as decimal(3,2)), 2) as decimal(12,2)) as total_price
from (select l_orderkey as bill_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
cast(floor(l_extendedprice / l_quantity) as decimal(12,2)) as unit_price,
cast(floor(l_extendedprice * l_discount) as decimal(12,2)) as discount, cast(l_tax * 100 as decimal(5,2)) as tax_rate from lineitem) x""",
    "payments": """
select id, id as bill_id, net_amount as amount, payment_method as method, case when status = 'refunded' then 'refunded' else 'completed' end as status,
case when payment_method = 'razorpay' then concat('pay_', cast(id as varchar(20))) end as gateway_transaction_id, cashier_id as processed_by, created_at
from bills where status in ('completed','partially_returned','refunded')
union all
select -id - 1, id, cast(-net_amount as decimal(12,2)), payment_method, 'refunded', case when payment_method = 'razorpay' then concat('pay_', cast(id as varchar(20))) end, cashier_id,
created_at + interval '1' day from bills where status = 'refunded'""",
    "returns": """
select b.id, b.id as bill_id, b.cashier_id, r.product_id, r.quantity, r.return_amount, b.created_at + interval '2' day as created_at
from bills b join (select bill_id, product_id, cast(sum(quantity) as int) as quantity, cast(sum(total_price) as decimal(12,2)) as return_amount from bill_items group by bill_id, product_id) r
on r.bill_id = b.id where b.status = 'partially_returned' and r.product_id % 2 = 0""",
    "stock_adjustments": """
select event_id as id, event_id % 200 as product_id, cast(floor(value) as int) * case when event_type in ('error','purchase') then -1 else 1 end as adjustment,
case event_type when 'view' then 'manual' when 'signup' then 'purchase' when 'error' then 'damage' when 'click' then 'return' else 'audit' end as type,
cast(user_id % 10 as int) as adjusted_by, ts as created_at from events""",
    "cart_events": """
select event_id as id, user_id as cart_id, event_id % 20 as product_id, case when event_type = 'error' then 'remove' else 'add' end as action, ts from events""",
}

PRELUDE = "with " + ",\n".join(f"{name} as ({body.strip()})" for name, body in _CTES.items())


def sql(body: str) -> str:
    """One statement: the model CTEs followed by ``body`` (a SELECT, or WITH ... SELECT)."""
    b = body.strip()
    m = re.match(r"with\s+recursive\s+", b, re.IGNORECASE)
    if m:
        return "with recursive " + PRELUDE[5:] + ",\n" + b[m.end():]
    m = re.match(r"with\s+", b, re.IGNORECASE)
    if m:
        return PRELUDE + ",\n" + b[m.end():]
    return PRELUDE + "\n" + b
