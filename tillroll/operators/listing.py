"""Listings, search, lookups and presentation columns.

Paged listings take the page from the (filtered) fact table first and only
then attach dimension names: the left joins to unique dimension keys change
neither the rows nor their order, so joining after the top-k touches
``limit`` rows instead of the whole table.  The dimension side is first cut
down to the page's keys by a semi-join with the broadcast page keys (bounded
by ``limit``).

Lookups by "any of several keys" (B13–B16) are equi-joins on unpivoted keys
(``plans.joins.lookup_codes``), never an OR join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ranges as R
from tillroll.functions.loyalty import points_to_next_tier
from tillroll.functions.money import total
from tillroll.functions.present import customer_label, status_badge
from tillroll.plans.joins import and_all, lookup_codes
from tillroll.plans.paging import after, page, paginate, top_k, top_k_per_group
from tillroll.plans.spread import rows_read, spread
from tillroll.session import checkpoint_dir
from tillroll.sources.schema import TOTAL


NULL_SPREAD = 1024


def attach(rows: DataFrame, key: str, dim: DataFrame, dim_key: str, cols: dict[str, str],
           rows_bounded: bool = True) -> DataFrame:
    """``rows ⟕ dim`` on ``rows[key] = dim[dim_key]`` adding ``cols`` (dim col -> output name).

    When ``rows`` is a bounded page (materialized with ``page_once``), the
    dimension is streamed past the broadcast page keys and only the matches
    meet the page; otherwise rows with a null key are salted so they do not
    pile into one partition.
    """
    d = dim.select(F.col(dim_key).alias("_dk"), *[F.col(c).alias(a) for c, a in cols.items()])
    if rows_bounded:
        keys = rows.select(F.col(key).alias("_dk")).filter(F.col("_dk").isNotNull()).distinct()
        d = d.join(F.broadcast(keys), "_dk", "left_semi")
        return rows.join(d, rows[key] == d["_dk"], "left").drop("_dk")
    # Rows without a key (walk-in bills, unmatched lookups) can never match,
    # but a shuffle would hash them all into the null key's one partition.
    # Joining on (key, salt) — salt 0 for keyed rows, a hash bucket 1..N for
    # null-keyed ones, 0 on the dimension side — spreads them out in the
    # same single pass (a struct key, so the salt is not folded away).  The bucket
    # is that of the row's own key, its first other column, so no further column is read.
    own = next((c for c in rows.columns if c != key), key)
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(F.col(own)), F.lit(NULL_SPREAD)) + 1).otherwise(F.lit(0).cast("bigint"))
    r = rows.withColumn("_jk", F.struct(F.col(key).alias("k"), salt.alias("s")))
    dj = d.withColumn("_jk", F.struct(F.col("_dk").alias("k"), F.lit(0).cast("bigint").alias("s"))).drop("_dk")
    return r.join(dj, "_jk", "left").drop("_jk")


def page_once(pg: DataFrame) -> DataFrame:
    """Materialize a page (<= limit rows) in the shared checkpoint folder.

    A page is used by every dimension it is joined with; without this each
    use would re-run the top-k over the whole fact table."""
    checkpoint_dir(pg.sparkSession)
    return pg.checkpoint(eager=True)


def _ilike_any(pattern: str, cols: list[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


# ------------------------------------------------------------------ B1 bills
BILL_LIST_COLS = ["id", "bill_number", "customer_id", "customer_name", "total_amount", "discount_amount",
                  "tax_amount", "net_amount", "payment_method", "status", "cashier_id", "cashier_name",
                  "created_at"]


def bills_filter(t, start=None, end=None, status=None, customer_id=None, role=None, user_id=None) -> DataFrame:
    """B1/B20 predicates: optional, and-ed; a cashier sees only their own bills."""
    b = t.bills_window(R.midnight(start) if start else None, R.midnight(end) if end else None,
                       end_inclusive=True)
    return b.filter(and_all([
        (F.col("cashier_id") == user_id) if role == "cashier" else None,
        (F.col("status") == status) if status else None,
        (F.col("customer_id") == customer_id) if customer_id is not None else None,
    ]))


def bills_list(t, start=None, end=None, status=None, customer_id=None, role=None, user_id=None,
               page_no: int = 1, limit: int = 20, cursor: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """B1 + B19: a page of bills, newest first, with customer and cashier names; and the total.

    ``cursor`` (``paging.cursor_of`` the page before) gives the page after it; pages are then counted from there."""
    b = bills_filter(t, start, end, status, customer_id, role, user_id)
    pg, tot = paginate(b, [F.col("created_at").desc_nulls_last()], page_no, limit, key="id",
                       page_df=after(b, "created_at", cursor, descending=True))
    pg = page_once(pg)
    pg = attach(pg, "customer_id", t.customers, "id", {"name": "customer_name"})
    pg = attach(pg, "cashier_id", t.users, "id", {"name": "cashier_name"})
    return pg.select(*BILL_LIST_COLS), tot


def bills_total(t, start=None, end=None, status=None, customer_id=None, role=None, user_id=None) -> DataFrame:
    """The total of ``bills_list`` alone; no page is built."""
    return bills_filter(t, start, end, status, customer_id, role, user_id).agg(F.count(F.lit(1)).alias("total"))


def with_presentation(df: DataFrame) -> DataFrame:
    """``Walk-in`` for bills without a customer, success/warning badge by status."""
    return df.withColumn("customer_label", customer_label("customer_name")) \
             .withColumn("status_badge", status_badge("status"))


# --------------------------------------------------------------- B2–B4 products
PRODUCT_LIST_COLS = ["id", "name", "sku", "barcode", "price", "tax_rate", "stock_quantity", "minimum_stock",
                     "unit", "category", "department_id", "department_name", "supplier_id", "supplier_name"]


def products_filter(t, department_id=None, category=None, in_stock: bool = False, search=None) -> DataFrame:
    p = t.products
    return p.filter(and_all([
        F.col("is_active"),
        (F.col("department_id") == department_id) if department_id is not None else None,
        (F.col("category") == category) if category else None,
        (F.col("stock_quantity") > 0) if in_stock else None,
        _ilike_any(f"%{search}%", ["name", "sku", "barcode"]) if search else None,
    ]))


def products_list(t, department_id=None, category=None, in_stock: bool = False, search=None,
                  page_no: int = 1, limit: int = 20, cursor: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """B2 + B19: active products by name with department and supplier names; ``cursor`` as in ``bills_list``."""
    p = products_filter(t, department_id, category, in_stock, search)
    pg, tot = paginate(p, [F.col("name").asc_nulls_last()], page_no, limit, page_df=after(p, "name", cursor))
    pg = page_once(pg)
    pg = attach(pg, "department_id", t.departments, "id", {"name": "department_name"})
    pg = attach(pg, "supplier_id", t.suppliers, "id", {"name": "supplier_name"})
    return pg.select(*PRODUCT_LIST_COLS), tot


def products_total(t, department_id=None, category=None, in_stock: bool = False, search=None) -> DataFrame:
    """The total of ``products_list`` alone; no page is built."""
    return products_filter(t, department_id, category, in_stock, search).agg(F.count(F.lit(1)).alias("total"))


def product_search(t, q: str, k: int = 20) -> DataFrame:
    """ILIKE on name or sku, exact barcode; active; first 20 by name."""
    pattern = f"%{q}%"
    p = t.products.filter(F.col("is_active") & (
        _ilike_any(pattern, ["name", "sku"]) | F.coalesce(F.col("barcode") == q, F.lit(False))))
    pg = page_once(top_k(p, [F.col("name").asc_nulls_last()], k))
    pg = attach(pg, "department_id", t.departments, "id", {"name": "department_name"})
    return pg.select("id", "name", "sku", "barcode", "price", "tax_rate", "stock_quantity", "unit", "category",
                     "department_id", "department_name")


def low_stock(t) -> DataFrame:
    """Active products at or below minimum stock, lowest first, with supplier contact."""
    p = t.products.filter(F.col("is_active") & (F.col("stock_quantity") <= F.col("minimum_stock")))
    p = attach(p, "department_id", t.departments, "id", {"name": "department_name"}, rows_bounded=False)
    p = attach(p, "supplier_id", t.suppliers, "id", {"name": "supplier_name", "contact_email": "supplier_email"},
               rows_bounded=False)
    return p.select("id", "name", "sku", "barcode", "stock_quantity", "minimum_stock", "unit", "department_id",
                    "department_name", "supplier_id", "supplier_name", "supplier_email") \
            .orderBy(F.col("stock_quantity").asc_nulls_last(), "id")


# --------------------------------------------------------------- B5–B7 customers
CUSTOMER_LIST_COLS = ["id", "name", "email", "phone", "loyalty_points", "loyalty_tier", "total_purchases"]


def customers_list(t, search=None, tier=None, page_no: int = 1, limit: int = 20,
                   cursor: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """B5 + B19: active customers by name; ILIKE on name, email or phone; ``cursor`` as in ``bills_list``."""
    c = t.customers.filter(and_all([
        F.col("is_active"),
        _ilike_any(f"%{search}%", ["name", "email", "phone"]) if search else None,
        (F.col("loyalty_tier") == tier) if tier else None,
    ])).select(*CUSTOMER_LIST_COLS)
    return paginate(c, [F.col("name").asc_nulls_last()], page_no, limit, page_df=after(c, "name", cursor))


HISTORY_COLS = ["id", "bill_number", "total_amount", "discount_amount", "tax_amount", "net_amount",
                "payment_method", "status", "created_at"]


def customer_history(t, customer_id, page_no: int = 1, limit: int = 10) -> DataFrame:
    """One customer's bills of every status, newest first."""
    b = t.bills.filter(F.col("customer_id") == customer_id)
    return page(b.select(*HISTORY_COLS), [F.col("created_at").desc_nulls_last()], page_no, limit)


def customer_history_all(t, limit: int = 10) -> DataFrame:
    """B6 re-aimed: the ``limit`` newest bills of every customer (top-k per group)."""
    b = t.bills.filter(F.col("customer_id").isNotNull()).select("customer_id", *HISTORY_COLS)
    return top_k_per_group(b, "customer_id", [F.col("created_at").desc_nulls_last()], limit)


def customer_spend(t) -> DataFrame:
    """Per customer, count and sum of completed bills (0 when none)."""
    b = t.bills.filter((F.col("status") == "completed") & F.col("customer_id").isNotNull())
    per = b.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), total("net_amount").alias("s"))
    c = t.customers.select("id")
    return c.join(per, c.id == per.customer_id, "left").select(
        "id", F.coalesce("n", F.lit(0).cast("bigint")).alias("total_bills"),
        F.coalesce("s", F.lit(0).cast(TOTAL)).alias("total_spent"))


def customer_loyalty(t) -> DataFrame:
    """Points to the next tier, judged by the stored tier."""
    return t.customers.select("id", "name", "loyalty_points", "loyalty_tier", "total_purchases",
                              points_to_next_tier("loyalty_tier", "loyalty_points").alias("points_to_next_tier"))


# --------------------------------------------------------------- B8 payments
def payments_list(t, start=None, end=None, method=None, status=None, page_no: int = 1,
                  limit: int = 20, cursor: dict | None = None) -> DataFrame:
    """Payments newest first with the bill number; no total; ``cursor`` as in ``bills_list``."""
    p = t.payments.filter(and_all([
        (F.col("created_at") >= R.ts_lit(R.midnight(start))) if start else None,
        (F.col("created_at") <= R.ts_lit(R.midnight(end))) if end else None,
        (F.col("method") == method) if method else None,
        (F.col("status") == status) if status else None,
    ]))
    p = after(p, "created_at", cursor, descending=True)
    pg = page_once(page(p, [F.col("created_at").desc_nulls_last()], page_no, limit))
    pg = attach(pg, "bill_id", t.bills, "id", {"bill_number": "bill_number"})
    return pg.select("id", "bill_id", "bill_number", "amount", "method", "status", "gateway_transaction_id",
                     "created_at")


# ------------------------------------------------------------- B9–B11 departments
def departments_list(t) -> DataFrame:
    """Active departments with the manager's name, by name."""
    d = t.departments.filter(F.col("is_active"))
    d = attach(d, "manager_id", t.users, "id", {"name": "manager_name"}, rows_bounded=False)
    return d.select("id", "name", "description", "manager_id", "manager_name", "is_active", "created_at") \
            .orderBy("name", "id")


def _active_products_per_department(t) -> DataFrame:
    p = t.products.filter(F.col("is_active") & F.col("department_id").isNotNull())
    return p.groupBy("department_id").agg(
        F.count_distinct("id").alias("product_count"),
        F.sum(F.col("stock_quantity") * F.col("price")).cast(TOTAL).alias("inventory_value"))


def department_stats(t) -> DataFrame:
    """Active departments with distinct active products and inventory value (0 if none)."""
    d = departments_list(t)
    per = _active_products_per_department(t)
    return d.join(per, d.id == per.department_id, "left").select(
        "id", "name", "description", "manager_id", "manager_name", "is_active",
        F.coalesce("product_count", F.lit(0).cast("bigint")).alias("product_count"),
        F.coalesce("inventory_value", F.lit(0).cast(TOTAL)).alias("inventory_value")).orderBy("name", "id")


def department_detail(t) -> DataFrame:
    """Every department with active product and active employee counts.

    The source crosses products × employees per department and repairs the
    fan-out with COUNT(DISTINCT); here each side is counted on its own and
    joined once (no fan-out)."""
    d = attach(t.departments, "manager_id", t.users, "id", {"name": "manager_name"}, rows_bounded=False)
    prod = _active_products_per_department(t).select("department_id", "product_count")
    emp = (t.users.filter(F.col("is_active") & F.col("department_id").isNotNull())
           .groupBy(F.col("department_id").alias("emp_dept")).agg(F.count_distinct("id").alias("employee_count")))
    return (d.join(prod, d.id == prod.department_id, "left").join(emp, d.id == emp.emp_dept, "left")
            .select("id", "name", "description", "manager_id", "manager_name", "is_active",
                    F.coalesce("product_count", F.lit(0).cast("bigint")).alias("product_count"),
                    F.coalesce("employee_count", F.lit(0).cast("bigint")).alias("employee_count")))


# ------------------------------------------------------------------ B12 documents
def bill_documents(t, bills: DataFrame | None = None) -> DataFrame:
    """Bill header with customer and cashier, plus its lines as a nested array.

    Lines are joined to products (inner, as the source) and collected per
    bill in a stable order; the array is built by a per-bill aggregate with a
    map-side partial step, then joined to the headers on the bill key."""
    b = t.bills if bills is None else bills
    items = t.bill_items
    p = t.products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"), "sku", "barcode")
    lines = items.join(p, items.product_id == p._pid, "inner")
    docs = lines.groupBy(F.col("bill_id").alias("_bid")).agg(F.sort_array(F.collect_list(F.struct(
        "product_id", "product_name", "sku", "barcode", "quantity", "unit_price", "discount", "tax_rate",
        "tax_amount", "total_price"))).alias("items"))
    h = attach(b, "customer_id", t.customers, "id", {"name": "customer_name", "phone": "customer_phone"},
               rows_bounded=False)
    h = attach(h, "cashier_id", t.users, "id", {"name": "cashier_name"}, rows_bounded=False)
    return h.join(docs, h.id == docs._bid, "left").drop("_bid")


def document_summary(docs: DataFrame) -> DataFrame:
    """Per document: number of lines, units and the sum of line totals (from the nested array)."""
    zero = F.lit(0).cast("decimal(18,2)")
    return docs.select(
        "id", "bill_number", "customer_name", "cashier_name", "net_amount", "status",
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("item_count"),
        F.coalesce(F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"]),
                   F.lit(0).cast("bigint")).alias("items_quantity"),
        F.coalesce(F.aggregate("items", zero, lambda a, x: (a + x["total_price"]).cast("decimal(18,2)")),
                   zero).alias("items_total"))


def document_lines(docs: DataFrame) -> DataFrame:
    """The nested lines of the documents, flat, with their place in the array (from 1)."""
    return docs.select("id", F.posexplode("items").alias("line_no", "x")).select(
        "id", (F.col("line_no") + 1).alias("line_no"), "x.*")


# ------------------------------------------------------------- B13–B16 lookups
def resolve_products(t, scans: DataFrame, code_col: str = "code") -> DataFrame:
    """A scanned code may be a product id, barcode or sku (inactive included)."""
    r = lookup_codes(scans, code_col, t.products, "id", ["id", "barcode", "sku"],
                     {c: c for c in ("name", "price", "stock_quantity", "department_id", "supplier_id")})
    r = attach(r, "department_id", t.departments, "id", {"name": "department_name"}, rows_bounded=False)
    r = attach(r, "supplier_id", t.suppliers, "id", {"name": "supplier_name"}, rows_bounded=False)
    return r.withColumnRenamed("matched_id", "product_id")


def completed_bill_counts(t) -> DataFrame:
    b = t.bills.filter((F.col("status") == "completed") & F.col("customer_id").isNotNull())
    return b.groupBy(F.col("customer_id").alias("_cid")).agg(F.count(F.lit(1)).alias("total_bills"))


def resolve_customers(t, keys: DataFrame, code_col: str = "code") -> DataFrame:
    """A key may be a customer id, phone or email; plus completed-bill count."""
    r = lookup_codes(keys, code_col, t.customers, "id", ["id", "phone", "email"],
                     {c: c for c in ("name", "loyalty_points", "loyalty_tier")})
    cnt = completed_bill_counts(t)
    r = r.join(cnt, r.matched_id == cnt._cid, "left").drop("_cid")
    return r.withColumn("total_bills", F.when(F.col("matched_id").isNotNull(),
                                              F.coalesce("total_bills", F.lit(0).cast("bigint")))) \
            .withColumnRenamed("matched_id", "customer_id")


def resolve_payments(t, keys: DataFrame, code_col: str = "code") -> DataFrame:
    """A key may be a payment id or a gateway transaction id; joined to its bill.

    A refund copies the gateway id of its payment, so one id can match
    several rows: the earliest (created_at, id) wins."""
    pay = t.payments
    b = t.bills.select(F.col("id").alias("_bid"), "bill_number", F.col("net_amount").alias("bill_amount"))
    pb = pay.join(b, pay.bill_id == b._bid, "inner").drop("_bid")
    r = lookup_codes(keys, code_col, pb, "id", ["id", "gateway_transaction_id"],
                     {c: c for c in ("bill_id", "bill_number", "amount", "method", "status", "bill_amount")}, ["created_at"])
    return r.withColumnRenamed("matched_id", "payment_id")


def resolve_bills(t, keys: DataFrame, code_col: str = "code") -> DataFrame:
    """A key may be a bill id or a bill number."""
    r = lookup_codes(keys, code_col, t.bills, "id", ["id", "bill_number"],
                     {c: c for c in ("bill_number", "net_amount", "status", "customer_id")})
    r = attach(r, "customer_id", t.customers, "id", {"name": "customer_name"}, rows_bounded=False)
    return r.withColumnRenamed("matched_id", "bill_id")


# ----------------------------------------------------------------- B18, B21
def user_profiles(t) -> DataFrame:
    """Users with their department name (no password column exists here)."""
    u = attach(t.users, "department_id", t.departments, "id", {"name": "department_name"}, rows_bounded=False)
    return u.select("id", "name", "email", "role", "department_id", "department_name")


def recent_bills(t, k: int = 10) -> DataFrame:
    """The newest completed bills with the customer's name."""
    b = t.bills.filter(F.col("status") == "completed")
    pg = page_once(top_k(b, [F.col("created_at").desc_nulls_last()], k))
    pg = attach(pg, "customer_id", t.customers, "id", {"name": "customer_name"})
    return pg.select("id", "bill_number", "net_amount", "payment_method", "status", "customer_name", "created_at")


# ------------------------------------------------------------------ B3b bulk search
#: Sizes of the substrings that products are found by, and products in a part while they are cut up.
_GRAMS, _GRAM_PRODUCTS = (1, 2, 3, 5, 8), 20_000


def bulk_product_search(t, terms: DataFrame, k: int = 20, term_col: str = "term") -> DataFrame:
    """``product_search`` for a whole table of search terms, first ``k`` per term.

    Exact, without a nested-loop join.  A term is an ILIKE pattern as in B3 (``%``, ``_``, backslash escapes).
    Its literal pieces must occur in the lower-cased name or sku, so one of their substrings is an equi-join key to
    the products that hold it, and ILIKE removes false candidates.  Substrings have the sizes of ``_GRAMS``; a term
    is looked up by the largest that its longest piece has, so that a whole sku finds few products however many there
    are, and by the rarest of that size: a prefix that all skus share never selects all products.  Only sizes that
    some term asks for are made, in parts of ``_GRAM_PRODUCTS`` products.
    Terms of wildcards alone only ask for a length; they are answered from the first ``k`` products of every length.
    Null and empty terms have no rows."""
    p = t.products.filter(F.col("is_active")).select("id", "name", "sku", "barcode", "price")
    parts = -(-rows_read(p) // _GRAM_PRODUCTS)
    parts = parts if parts > 1 else None
    q = terms.select(F.col(term_col).alias("term")).filter(F.length("term") > 0).distinct()
    # a backslash before an ordinary character means that character
    q = q.withColumn("_p", F.concat(F.lit("%"), F.regexp_replace("term", r"(\\[\\%_])|\\(.)", "$1$2"), F.lit("%")))
    runs = F.regexp_extract_all(F.lower("_p"), F.lit(r"((?:\\[\\%_]|[^%_\\])+)"), F.lit(1))
    q = q.withColumn("_pieces", F.transform(runs, lambda x: F.regexp_replace(x, r"\\(.)", "$1")))
    longest = F.array_max(F.transform("_pieces", F.length))
    size = F.lit(_GRAMS[0])
    for n in _GRAMS[1:]:
        size = F.when(longest >= n, n).otherwise(size)

    def substrings(text: Column, n: Column) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, n))) \
            .otherwise(F.array().cast("array<string>"))

    literal = q.filter(F.size("_pieces") > 0).withColumn("_n", size)
    asked_sizes = sorted(r[0] for r in literal.select("_n").distinct().collect())  # at most as many as _GRAMS has
    texts = p if parts is None else p.repartition(parts, "id")
    held_by = F.flatten(F.array(*[substrings(F.lower(c), F.lit(n)) for c in ("name", "sku") for n in asked_sizes or _GRAMS[:1]]))
    grams = spread(texts.select("id", F.explode(F.array_distinct(held_by)).alias("gram")), parts, "gram")
    per_term = literal.select("term", "_p", F.explode(F.array_distinct(F.flatten(F.transform(
        "_pieces", lambda x: substrings(x, F.col("_n")))))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_held"))
    large = (lambda df: df.hint("merge")) if parts else (lambda df: df)  # a file of some MB may hold a million products
    rarest = (per_term.join(large(held), "gram", "left").groupBy("term", "_p")
              .agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), "gram")).alias("_r"))
              .select("term", "_p", F.col("_r.gram").alias("gram")))
    found_by = large(grams).join(rarest, "gram").select("term", "_p", "id")
    if parts:
        found_by = found_by.repartition(parts, "id")
    hit = found_by.join(large(texts), "id").filter(F.expr("name ilike _p or sku ilike _p"))
    by_code = large(p).join(q.select("term"), p.barcode == F.col("term"))
    # wildcards alone: every text of at least as many characters as the term has underscores
    wild = q.filter(F.size("_pieces") == 0)
    cols = ["term", "id", "name", "sku", "price"]
    found = hit.select(*cols).unionByName(by_code.select(*cols))
    length = F.greatest(F.coalesce(F.length("name"), F.lit(-1)), F.coalesce(F.length("sku"), F.lit(-1)))
    order = [F.col("name").asc_nulls_last()]
    first = top_k_per_group(p.select("id", "name", "sku", "price", length.alias("_l")), "_l", order, k).drop("rank")
    at_least = first.filter("_l >= 0").select("id", "name", "sku", "price", F.explode(F.sequence(F.lit(0), F.col("_l"))).alias("_m"))
    asked = wild.select("term", F.length(F.regexp_replace("_p", "%", "")).alias("_m"))
    best = top_k_per_group(at_least, "_m", order, k).drop("rank")
    found = found.unionByName(asked.join(best, "_m").select(*cols))
    found = (found.repartition(parts, "term", "id") if parts else found).distinct()
    return top_k_per_group(found, "term", order, k)


def name_words(t) -> DataFrame:
    """Search terms typed at the till, derived from the catalogue: every word of every product name."""
    return t.products.select(F.explode(F.split(F.lower(F.regexp_replace("name", "[0-9]+", "")), " ")).alias("term")) \
        .filter(F.length("term") > 0).distinct()


def typed_terms(t) -> DataFrame:
    """Search terms of every kind: all words, all skus, and words and skus with wildcards in them."""
    w, s = name_words(t), t.products.select(F.lower("sku").alias("term"))
    one = s.select(F.concat(F.lit("_"), F.substring("term", 2, 3), F.lit("%"), F.expr("right(term, 2)")).alias("term"))
    two = w.select(F.concat(F.expr("left(term, 2)"), F.lit("%"), F.expr("right(term, 1)")).alias("term"))
    alone = w.select(F.regexp_replace("term", ".", "_").alias("term"))
    return w.unionByName(s).unionByName(one).unionByName(two).unionByName(alone).distinct()
