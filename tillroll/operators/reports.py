"""Sales analytics over completed bills.

Every report takes a ``Retail`` catalog plus explicit parameters (``as_of``
replaces the wall clock).  Time windows reach the bills scan through
``Retail.bills_window`` so they are pushed to Parquet.  Joins with bill lines
aggregate the lines per product/bill *before* meeting a dimension, so a hot
product or department is reduced by map-side partial aggregation instead of
being shuffled row by row.

Quirks of the source queries are reproduced by default (see SURVEY §2.H):
Q1 (``monthly_by_department``, ``product_report``), Q2 (``department_report``)
and Q3 (``between_dates``).  ``*_fixed`` functions give the evident intent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ranges as R
from tillroll.functions.money import mean0, total, total0
from tillroll.plans.paging import top_k
from tillroll.sources.schema import TOTAL

COMPLETED = "completed"


def _count() -> F.Column:
    return F.count(F.lit(1))


def _figures(b: DataFrame, discounts: bool = True, avg: bool = True, tax: bool = True,
             unique_customers: bool = False) -> DataFrame:
    cols = [_count().alias("total_transactions"), total0("net_amount").alias("total_revenue")]
    if tax:
        cols.append(total0("tax_amount").alias("total_tax"))
    if discounts:
        cols.append(total0("discount_amount").alias("total_discounts"))
    if avg:
        cols.append(mean0("net_amount").alias("avg_transaction_value"))
    if unique_customers:
        cols.append(F.count_distinct("customer_id").alias("unique_customers"))
    return b.agg(*cols)


# --------------------------------------------------------------- dashboard
def dashboard_today(t, as_of) -> DataFrame:
    """today's count, revenue, tax, discounts and mean bill."""
    return _figures(R.bills_in(t, R.day(as_of)))


def dashboard_week(t, as_of) -> DataFrame:
    """Since Monday 00:00 of as_of's week, no upper bound."""
    return _figures(R.bills_in(t, R.since_week_start(as_of)), discounts=False, avg=False, tax=False)


def dashboard_month(t, as_of) -> DataFrame:
    """Since the 1st of as_of's month, no upper bound."""
    return _figures(R.bills_in(t, R.since_month_start(as_of)), discounts=False, avg=False, tax=False)


def low_stock_filter(p: DataFrame) -> DataFrame:
    return p.filter(F.col("is_active") & (F.col("stock_quantity") <= F.col("minimum_stock")))


def low_stock_count(t) -> DataFrame:
    """C4: active products at or below their minimum stock."""
    return low_stock_filter(t.products).agg(_count().alias("low_stock_alerts"))


def dashboard(t, as_of) -> DataFrame:
    """C1–C4 in one row from a single pass over the bills.

    Today, this week and this month are conditional aggregates over bills
    since the earlier of week start and month start; the low-stock count is
    a second one-row aggregate.  The two rows are stacked and collapsed with
    ``max`` (each column is non-null in exactly one of them), so no join.
    """
    ws, ms = R.week_start(as_of), R.month_start(as_of)
    d = R.day(as_of)
    b = t.bills_window(min(ws, ms), None, status=COMPLETED)
    c = F.col("created_at")
    today = (c >= R.ts_lit(d.start)) & (c < R.ts_lit(d.end))
    week = c >= R.ts_lit(ws)
    month = c >= R.ts_lit(ms)

    def cnt(cond):
        return F.count(F.when(cond, 1))

    def tot(cond, col):
        return F.coalesce(F.sum(F.when(cond, F.col(col))).cast(TOTAL), F.lit(0).cast(TOTAL))

    figures = b.agg(
        cnt(today).alias("today_transactions"), tot(today, "net_amount").alias("today_revenue"),
        tot(today, "tax_amount").alias("today_tax"), tot(today, "discount_amount").alias("today_discounts"),
        F.coalesce(F.try_divide(F.sum(F.when(today, F.col("net_amount"))).cast("double"),
                                F.count(F.when(today, F.col("net_amount")))), F.lit(0.0))
        .alias("today_avg_transaction_value"),
        cnt(week).alias("week_transactions"), tot(week, "net_amount").alias("week_revenue"),
        cnt(month).alias("month_transactions"), tot(month, "net_amount").alias("month_revenue"))
    alerts = low_stock_count(t)
    stacked = figures.unionByName(alerts, allowMissingColumns=True)
    return stacked.agg(*[F.max(x).alias(x) for x in figures.columns + alerts.columns])


# ------------------------------------------------------------------- daily
def daily_summary(t, date) -> DataFrame:
    """One day's figures plus distinct customers (walk-ins not counted)."""
    return _figures(R.bills_in(t, R.day(date)), unique_customers=True)


def daily_hourly(t, date) -> DataFrame:
    """Per hour of the day; hours without bills are absent."""
    b = R.bills_in(t, R.day(date))
    return (b.groupBy(F.hour("created_at").cast("int").alias("hour"))
            .agg(_count().alias("transactions"), total0("net_amount").alias("revenue"))
            .orderBy("hour"))


def daily_payment_mix(t, date) -> DataFrame:
    """Per payment method, largest amount first."""
    b = R.bills_in(t, R.day(date))
    return (b.groupBy("payment_method")
            .agg(_count().alias("count"), total0("net_amount").alias("amount"))
            .orderBy(F.col("amount").desc(), "payment_method"))


def _line_totals_for(t, bills: DataFrame) -> DataFrame:
    """Bill lines of the given bills aggregated per product (map-side partial agg)."""
    ids = bills.select(F.col("id").alias("_bid"))
    items = t.bill_items
    return (items.join(ids, items.bill_id == ids._bid, "inner")
            .groupBy("product_id")
            .agg(F.sum("quantity").cast("bigint").alias("total_sold"),
                 total("total_price").alias("revenue"), total("tax_amount").alias("tax_collected")))


def daily_top_products(t, date, k: int = 10) -> DataFrame:
    """The day's products by revenue (lines ⋈ products ⋈ bills)."""
    per_product = _line_totals_for(t, R.bills_in(t, R.day(date)))
    p = t.products.select("id", "name")
    j = per_product.join(p, per_product.product_id == p.id, "inner").select("id", "name", "total_sold", "revenue")
    return top_k(j, [F.col("revenue").desc_nulls_last()], k)


# ------------------------------------------------------------------ weekly
def weekly_by_day(t, week_start=None, as_of=None) -> DataFrame:
    """Per day of a 7-day week; day name blank-padded to 9 like TO_CHAR 'Day'."""
    start = R.midnight(week_start) if week_start is not None else R.week_start(as_of)
    b = R.bills_in(t, R.week(start))
    return (b.groupBy(F.to_date("created_at").alias("date"),
                      F.rpad(F.date_format("created_at", "EEEE"), 9, " ").alias("day_name"))
            .agg(_count().alias("total_transactions"), total0("net_amount").alias("total_revenue"),
                 total0("tax_amount").alias("total_tax"))
            .orderBy("date"))


def weekly_totals(t, week_start=None, as_of=None) -> DataFrame:
    """C11: totals of the same week."""
    start = R.midnight(week_start) if week_start is not None else R.week_start(as_of)
    return _figures(R.bills_in(t, R.week(start)), discounts=False)


# ----------------------------------------------------------------- monthly
def monthly_summary(t, year: int, month: int) -> DataFrame:
    """A calendar month's figures (as C6)."""
    return _figures(R.bills_in(t, R.month(year, month)), unique_customers=True)


def monthly_by_week(t, year: int, month: int) -> DataFrame:
    """Per week, clipped to the month, labelled by its Monday."""
    b = R.bills_in(t, R.month(year, month))
    return (b.groupBy(F.date_trunc("week", "created_at").cast("date").alias("week_start"))
            .agg(_count().alias("transactions"), total0("net_amount").alias("revenue"))
            .orderBy("week_start"))


def monthly_by_department(t, year: int, month: int) -> DataFrame:
    """C14 (quirk Q1): departments ⟕ products ⟕ lines ⟕ bills(month, completed in ON).

    The bill condition only decides which lines count in ``transactions``
    (lines, not bills); ``revenue`` sums all lines of all time and statuses.
    """
    # All lines are summed without a join; only the month's lines meet its bills.
    ids = R.bills_in(t, R.month(year, month)).select(F.col("id").alias("_bid"))
    items = t.bill_items
    ever = items.groupBy("product_id").agg(F.sum("total_price").alias("rev"), F.lit(0).cast("bigint").alias("n"))
    hits = items.join(ids, items.bill_id == ids._bid, "left_semi").groupBy("product_id").agg(
        F.lit(0).cast(ever.schema["rev"].dataType).alias("rev"), _count().alias("n"))
    per_product = ever.unionByName(hits)
    p = t.products.select("id", "department_id")
    per_dept = (per_product.join(p, per_product.product_id == p.id, "inner")
                .groupBy("department_id").agg(F.sum("n").alias("n"), F.sum("rev").alias("rev")))
    d = t.departments.select("id", "name")
    return (d.join(per_dept, d.id == per_dept.department_id, "left")
            .select(F.col("name").alias("department"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("transactions"),
                    F.coalesce(F.col("rev").cast(TOTAL), F.lit(0).cast(TOTAL)).alias("revenue"))
            .orderBy(F.col("revenue").desc(), "department"))


def _dept_figures(t, bills: DataFrame, department_id=None) -> DataFrame:
    """Per department: distinct bills, units, revenue and tax over the lines of ``bills``.

    Lines meet the bills and the product's department first.  Distinct bills are counted
    exactly by bitmaps: per department and block of 32,768 bill ids one bitmap, made in every task and
    summed up after the shuffle, so no line is shuffled by (bill, product) or (department, bill)."""
    ids = bills.select(F.col("id").alias("_bid"))
    items = t.bill_items.select("bill_id", "product_id", "quantity", "total_price", "tax_amount")
    p = t.products.select(F.col("id").alias("_pid"), "department_id")
    if department_id is not None:
        p = p.filter(F.col("department_id") == department_id)
    lines = items.join(ids, items.bill_id == ids._bid, "left_semi").join(p, items.product_id == p._pid, "inner")
    blocks = lines.groupBy("department_id", F.bitmap_bucket_number("bill_id").alias("_block")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("bill_id"))).alias("_bills"),
        F.sum("quantity").alias("q"), F.sum("total_price").alias("rev"), F.sum("tax_amount").alias("tax"))
    return blocks.groupBy("department_id").agg(
        F.sum("_bills").alias("total_bills"), F.sum("q").cast("bigint").alias("items_sold"),
        F.sum("rev").cast(TOTAL).alias("revenue"), F.sum("tax").cast(TOTAL).alias("tax_collected"))


def monthly_by_department_fixed(t, year: int, month: int) -> DataFrame:
    """C14 intent: per department, distinct completed bills and revenue of that month."""
    figs = _dept_figures(t, R.bills_in(t, R.month(year, month)))
    d = t.departments.select("id", "name")
    return (d.join(figs, d.id == figs.department_id, "left")
            .select(F.col("name").alias("department"),
                    F.coalesce("total_bills", F.lit(0).cast("bigint")).alias("transactions"),
                    F.coalesce("revenue", F.lit(0).cast(TOTAL)).alias("revenue"))
            .orderBy(F.col("revenue").desc(), "department"))


# --------------------------------------------------------------- period reports
def department_report(t, start, end, department_id=None) -> DataFrame:
    """C15 (quirk Q2): WHERE on bills after the left joins makes it an inner join —
    departments without sales in the range are absent."""
    figs = _dept_figures(t, R.bills_in(t, R.between_dates(start, end)), department_id)
    d = t.departments.select("id", F.col("name").alias("department"))
    return (d.join(figs, d.id == figs.department_id, "inner")
            .select("id", "department", "total_bills", "items_sold", "revenue", "tax_collected")
            .orderBy(F.col("revenue").desc(), "id"))


def department_report_fixed(t, start, end, department_id=None) -> DataFrame:
    """C15 intent: every department (of the filter), zero rows kept."""
    figs = _dept_figures(t, R.bills_in(t, R.between_dates(start, end)), department_id)
    d = t.departments.select("id", F.col("name").alias("department"))
    if department_id is not None:
        d = d.filter(F.col("id") == department_id)
    z = F.lit(0)
    return (d.join(figs, d.id == figs.department_id, "left")
            .select("id", "department",
                    F.coalesce("total_bills", z.cast("bigint")).alias("total_bills"),
                    F.coalesce("items_sold", z.cast("bigint")).alias("items_sold"),
                    F.coalesce("revenue", z.cast(TOTAL)).alias("revenue"),
                    F.coalesce("tax_collected", z.cast(TOTAL)).alias("tax_collected"))
            .orderBy(F.col("revenue").desc(), "id"))


def _product_report(t, per_product: DataFrame, department_id, k: int) -> DataFrame:
    p = t.products.filter(F.col("is_active"))
    if department_id is not None:
        p = p.filter(F.col("department_id") == department_id)
    p = p.select("id", "name", "sku", "category", "stock_quantity")
    z = F.lit(0)
    j = p.join(per_product, p.id == per_product.product_id, "left").select(
        "id", "name", "sku", "category",
        F.coalesce("total_sold", z.cast("bigint")).alias("total_sold"),
        F.coalesce("revenue", z.cast(TOTAL)).alias("revenue"),
        F.coalesce("tax_collected", z.cast(TOTAL)).alias("tax_collected"),
        F.col("stock_quantity").alias("current_stock"))
    return top_k(j, [F.col("revenue").desc_nulls_last()], k)


def product_report(t, start, end, department_id=None, k: int = 20) -> DataFrame:
    """C16 (quirk Q1): the bill condition sits in the ON clause of the bills join
    while the sums are over lines, so figures are all-time, all-status."""
    items = t.bill_items
    per_product = items.groupBy("product_id").agg(
        F.sum("quantity").cast("bigint").alias("total_sold"), total("total_price").alias("revenue"),
        total("tax_amount").alias("tax_collected"))
    return _product_report(t, per_product, department_id, k)


def product_report_fixed(t, start, end, department_id=None, k: int = 20) -> DataFrame:
    """C16 intent: sums over completed bills of the range only."""
    per_product = _line_totals_for(t, R.bills_in(t, R.between_dates(start, end)))
    return _product_report(t, per_product, department_id, k)


def cashier_report(t, start, end) -> DataFrame:
    """C17: active cashiers, including those without bills in the range."""
    b = R.bills_in(t, R.between_dates(start, end))
    per = b.groupBy("cashier_id").agg(
        _count().alias("n"), F.sum("net_amount").alias("net"), F.sum("discount_amount").alias("disc"))
    u = t.users.filter((F.col("role") == "cashier") & F.col("is_active")).select("id", F.col("name").alias("cashier"))
    z = F.lit(0)
    return (u.join(per, u.id == per.cashier_id, "left")
            .select("id", "cashier", F.coalesce("n", z.cast("bigint")).alias("total_bills"),
                    F.coalesce(F.col("net").cast(TOTAL), z.cast(TOTAL)).alias("total_revenue"),
                    F.coalesce(F.try_divide(F.col("net").cast("double"), F.col("n")), F.lit(0.0))
                    .alias("avg_bill_value"),
                    F.coalesce(F.col("disc").cast(TOTAL), z.cast(TOTAL)).alias("total_discounts"))
            .orderBy(F.col("total_revenue").desc(), "id"))


def tax_summary(t, start, end) -> DataFrame:
    """C18."""
    b = R.bills_in(t, R.between_dates(start, end))
    return b.agg(_count().alias("total_bills"), total0("net_amount").alias("total_revenue"),
                 total0("tax_amount").alias("total_tax_collected"))


def tax_by_rate(t, start, end) -> DataFrame:
    """Per line tax rate — taxable base, tax and distinct bills."""
    ids = R.bills_in(t, R.between_dates(start, end)).select(F.col("id").alias("_bid"))
    items = t.bill_items
    # distinct bills by bitmaps, as in the department report
    blocks = (items.join(ids, items.bill_id == ids._bid, "left_semi")
              .groupBy("tax_rate", F.bitmap_bucket_number("bill_id").alias("_block"))
              .agg(F.sum(F.col("total_price") - F.col("tax_amount")).alias("base"), F.sum("tax_amount").alias("tax"),
                   F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("bill_id"))).alias("_bills")))
    return (blocks.groupBy("tax_rate")
            .agg(total0("base").alias("taxable_amount"), total0("tax").alias("tax_amount"), F.sum("_bills").alias("bills_count"))
            .orderBy(F.col("tax_rate").asc_nulls_last()))


def top_products(t, start, end, k: int = 10) -> DataFrame:
    """C20: by quantity sold; inactive products included."""
    per_product = _line_totals_for(t, R.bills_in(t, R.between_dates(start, end)))
    p = t.products.select("id", "name", "sku", "category")
    j = per_product.join(p, per_product.product_id == p.id, "inner").select(
        "id", "name", "sku", "category", "total_sold", "revenue")
    return top_k(j, [F.col("total_sold").desc_nulls_last()], k)


def top_customers(t, start, end, k: int = 10) -> DataFrame:
    """By amount spent; bills are aggregated per customer before the join."""
    b = R.bills_in(t, R.between_dates(start, end)).filter(F.col("customer_id").isNotNull())
    per = b.groupBy("customer_id").agg(_count().alias("total_bills"), total("net_amount").alias("total_spent"))
    c = t.customers.select("id", "name", "email", "phone", "loyalty_tier")
    j = c.join(per, c.id == per.customer_id, "inner").select(
        "id", "name", "email", "phone", "loyalty_tier", "total_bills", "total_spent")
    return top_k(j, [F.col("total_spent").desc_nulls_last()], k)


def bundle(t, name: str, as_of, **params) -> dict[str, DataFrame]:
    """All frames of a named report, with the source's default periods taken from ``as_of``.

    Without parameters: the day, ISO week or month of ``as_of``; the 30 days before it for
    the period reports; its own date for the cashiers.  An unknown name gives the dashboard.
    The frames are built independently, so a caller runs only those it reads."""
    day = R.to_date(as_of)
    month_args = {"year": params.get("year") or day.year, "month": params.get("month") or day.month}
    date = params.get("date") or day
    week = {"week_start": params.get("week_start"), "as_of": as_of}
    default = R.between_dates(day, day) if name == "cashier" else R.last_30_days(as_of)
    span = {"start": params.get("start") or default.start, "end": params.get("end") or default.end}
    dep = {"department_id": params["department_id"]} if params.get("department_id") is not None else {}
    k = {"k": params["k"]} if params.get("k") is not None else {}
    if name == "daily":
        return {"summary": daily_summary(t, date), "hourly": daily_hourly(t, date),
                "payments": daily_payment_mix(t, date), "top_products": daily_top_products(t, date)}
    if name == "weekly":
        return {"by_day": weekly_by_day(t, **week), "totals": weekly_totals(t, **week)}
    if name == "monthly":
        return {"summary": monthly_summary(t, **month_args), "by_week": monthly_by_week(t, **month_args),
                "by_department": monthly_by_department(t, **month_args)}
    if name == "department":
        return {"departments": department_report(t, **span, **dep)}
    if name == "product":
        return {"products": product_report(t, **span, **dep, **k)}
    if name == "cashier":
        return {"cashiers": cashier_report(t, **span)}
    if name == "tax":
        return {"summary": tax_summary(t, **span), "by_rate": tax_by_rate(t, **span)}
    if name == "top-products":
        return {"products": top_products(t, **span, **k)}
    if name == "top-customers":
        return {"customers": top_customers(t, **span, **k)}
    from tillroll.operators.listing import recent_bills
    return {"today": dashboard_today(t, as_of), "week": dashboard_week(t, as_of), "month": dashboard_month(t, as_of),
            "low_stock": low_stock_count(t), "recent_bills": recent_bills(t)}


def report(t, name: str, **params) -> DataFrame:
    """The first figures of a named report (``bundle`` gives all); an unknown name falls back to the dashboard."""
    fn = {
        "dashboard": dashboard, "daily": daily_summary, "weekly": weekly_by_day, "monthly": monthly_summary,
        "department": department_report, "product": product_report, "cashier": cashier_report,
        "tax": tax_summary, "top-products": top_products, "top-customers": top_customers,
    }.get(name, dashboard)
    return fn(t, **params)


def net_sales(t, start, end) -> DataFrame:
    """Q6 extra: sales net of returns.  A partially returned bill leaves every
    status-filtered report although only part of it came back; here it
    counts, and what was returned is subtracted."""
    b = t.bills_window(R.midnight(start), R.midnight(end), end_inclusive=True).filter(
        F.col("status").isin("completed", "partially_returned"))
    ret = t.returns.groupBy(F.col("bill_id").alias("_rb")).agg(F.sum("return_amount").alias("_ret"))
    j = b.join(ret, b.id == ret._rb, "left")
    return j.agg(_count().alias("total_bills"), total0("net_amount").alias("gross_revenue"),
                 total0("_ret").alias("returned_amount"),
                 F.coalesce(F.sum(F.col("net_amount") - F.coalesce("_ret", F.lit(0))).cast(TOTAL),
                            F.lit(0).cast(TOTAL)).alias("net_sales"))
