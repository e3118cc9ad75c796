"""Inserts, patches, soft deletes, uniqueness and constraint checks.

All checks are joins and aggregates: ``left_semi`` finds conflicts,
``left_anti`` the accepted rows, ``groupBy(key).count() > 1`` duplicates.
Nothing is collected; every result is a DataFrame of rows or violations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.plans.joins import first_per_key
from tillroll.plans.sequence import global_row_number
from tillroll.session import checkpoint_dir
from tillroll.sources.schema import (ADJUSTMENT_TYPES, BILL_METHODS, BILL_STATUSES, ORDER_METHODS,
                                     PAYMENT_STATUSES, ROLES, TIERS)


# ------------------------------------------------------------------ A2 insert
def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str],
                  order: list[str] | None = None) -> DataFrame:
    """``INSERT … ON CONFLICT (keys) DO NOTHING``: the batch rows whose key is new.

    In-batch duplicates keep the first row under ``order`` (then the other
    columns), chosen by a map-side-combinable aggregate."""
    first = first_per_key(batch, keys, [c for c in (order or []) if c not in keys]).select(*batch.columns)
    return first.join(target.select(*keys), keys, "left_anti")


def insert_absent_into(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Target after the insert (``unionByName``)."""
    return target.unionByName(insert_absent(target, batch, keys).select(*target.columns))


# ------------------------------------------------------------------ D19 patch
def apply_patch(target: DataFrame, patch: DataFrame, key: str, cols: list[str],
                touch: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``UPDATE … SET c = COALESCE($new, c)``: (patched rows, rejected patch rows).

    Null in the patch keeps the old value (Q21: a patch cannot set NULL).
    Several patches of one key: the later one (by ``patch_seq`` when present)
    wins per column.  Unknown keys go to the reject table.  ``touch`` sets
    ``updated_at`` on every row that a patch names, even with equal values;
    other rows keep theirs (D25)."""
    if "patch_seq" in patch.columns:
        # latest non-null value per column: max_by skips rows whose ordering is null
        patch = patch.groupBy(key).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("patch_seq"))).alias(c) for c in cols])
    p = patch.select(F.col(key).alias("_pk"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = target.join(p, target[key] == p._pk, "left")
    out = j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                     for c in target.columns],
                   F.col("_pk").isNotNull().alias("_named"),
                   reduce(lambda a, b: a | b, [F.coalesce(~F.col(f"_new_{c}").eqNullSafe(F.col(c)), F.lit(False))
                                               & F.col(f"_new_{c}").isNotNull() for c in cols]).alias("changed"))
    if touch is not None:
        kept = F.col("updated_at") if "updated_at" in target.columns else F.lit(None)
        out = out.withColumn("updated_at", F.when(F.col("_named"), touch).otherwise(kept))
    out = out.drop("_named")
    rejects = patch.join(target.select(F.col(key).alias(key)), key, "left_anti")
    return out, rejects


# ------------------------------------------------------------- D20, D21 deletes
def soft_delete(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``is_active = false`` for the listed keys."""
    hit = ids.select(F.col(key).alias("_dk")).distinct().withColumn("_hit", F.lit(True))
    j = target.join(hit, target[key] == hit._dk, "left")
    return j.select(*[F.when(F.col("_hit"), F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_active"
                      else F.col(c) for c in target.columns], F.coalesce("_hit", F.lit(False)).alias("changed"))


def department_deactivation(departments: DataFrame, products: DataFrame, requests: DataFrame
                            ) -> tuple[DataFrame, DataFrame]:
    """(allowed, blocked) deactivation requests (``department_id``): a department
    holding active products may not be deactivated."""
    active = products.filter(F.col("is_active") & F.col("department_id").isNotNull()) \
        .select(F.col("department_id").alias("_d")).distinct()
    req = requests.join(departments.select(F.col("id").alias("department_id")), "department_id", "left_semi")
    blocked = req.join(active, req.department_id == active._d, "left_semi")
    allowed = req.join(active, req.department_id == active._d, "left_anti")
    return allowed, blocked


# ------------------------------------------------------------- D22 uniqueness
def unique_on_create(target: DataFrame, batch: DataFrame, keys: list[str], id_col: str = "request_id",
                     normalise: dict[str, Column] | None = None) -> DataFrame:
    """Per batch row, the first unique key that conflicts, or null when the row is accepted.

    Rows are taken in ``id_col`` order (rows of one id by their content's hash, equal rows in any), as inserts one after another: a row
    conflicts with the table or with an earlier row that was accepted; a refused row
    blocks nobody.  Rounds decide a row once no earlier undecided row holds
    one of its keys; each decides at least the first.  Null alternate keys never
    conflict.  ``normalise`` maps a key to an expression over that column
    (e.g. lower-cased e-mail)."""
    norm = normalise or {}

    def k(c: str) -> Column:
        return norm[c](F.col(c)) if c in norm else F.col(c)

    # An id may come twice: the row's place, not its id, says who was first.
    placed = global_row_number(batch.withColumn("_row", F.xxhash64(*batch.columns)), [id_col, "_row"], "_pos")
    state = placed.select(*batch.columns, "_pos", *[k(c).alias(f"_k_{c}") for c in keys])
    for c in keys:
        held = target.select(k(c).alias("_v")).filter(F.col("_v").isNotNull()).distinct().withColumn(f"_in_{c}", F.lit(True))
        state = state.join(held, state[f"_k_{c}"] == held._v, "left").drop("_v")
    clash = [F.when(F.col(f"_in_{c}"), F.lit(True)) for c in keys]
    state = state.withColumn("_st", F.when(F.coalesce(*clash), "R").otherwise("U"))
    checkpoint_dir(batch.sparkSession)
    state = state.checkpoint(eager=True)
    before = None
    while (open_rows := state.filter(F.col("_st") == "U").count()) > 0:
        if open_rows == before:
            raise RuntimeError(f"a round decided none of {open_rows} rows")
        before = open_rows
        state = _with_first(state, keys)
        late = reduce(lambda x, y: x | y, [F.coalesce(F.col("_pos") > F.col(f"_won_{c}"), F.lit(False)) for c in keys])
        lead = reduce(lambda x, y: x & y, [F.coalesce(F.col("_pos") == F.col(f"_lead_{c}"), F.lit(True)) for c in keys])
        state = state.withColumn("_st", F.when((F.col("_st") == "U") & late, "R").when((F.col("_st") == "U") & lead, "A")
                                 .otherwise(F.col("_st")))
        state = state.drop(*[f"_{x}_{c}" for c in keys for x in ("won", "lead")]).checkpoint(eager=True)
    state = _with_first(state, keys)
    reasons = [r for c in keys for r in (F.when(F.col(f"_in_{c}"), F.lit(f"{c}_exists")),
                                         F.when(F.col("_pos") > F.col(f"_won_{c}"), F.lit(f"{c}_repeated_in_batch")))]
    return state.select(*batch.columns, F.when(F.col("_st") == "R", F.coalesce(*reasons)).alias("conflict"))


def _with_first(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the first accepted row (``_won_``) and the first row not refused (``_lead_``) that hold the same value."""
    for c in keys:
        first = state.filter(F.col(f"_k_{c}").isNotNull() & (F.col("_st") != "R")).groupBy(F.col(f"_k_{c}").alias("_fk")).agg(
            F.min(F.when(F.col("_st") == "A", F.col("_pos"))).alias(f"_won_{c}"), F.min("_pos").alias(f"_lead_{c}"))
        state = state.join(first, state[f"_k_{c}"] == first._fk, "left").drop("_fk")
    return state


# ------------------------------------------------------------- D22a–c defaults, rules
PRODUCT_DEFAULTS = {"tax_rate": "0", "stock_quantity": 0, "minimum_stock": 5, "unit": "piece", "is_active": True}
CUSTOMER_DEFAULTS = {"loyalty_points": 0, "loyalty_tier": "bronze", "total_purchases": "0", "is_active": True}


def with_defaults(batch: DataFrame, defaults: dict, types: dict[str, str] | None = None) -> DataFrame:
    """``coalesce(col, default)`` for each default (missing columns are added)."""
    types = types or {}
    out = batch
    for c, v in defaults.items():
        lit = F.lit(v).cast(types[c]) if c in types else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), lit) if c in batch.columns else lit)
    return out


def _missing(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def product_rules(batch: DataFrame) -> DataFrame:
    """Name, sku and a truthy price are required (price 0 is refused as falsy)."""
    r = (F.when(_missing("name"), "name_required").when(_missing("sku"), "sku_required")
         .when(F.col("price").isNull() | (F.col("price") == 0), "price_required"))
    return batch.withColumn("reject_reason", r)


def customer_rules(batch: DataFrame) -> DataFrame:
    r = F.when(_missing("name"), "name_required").when(_missing("phone"), "phone_required")
    return batch.withColumn("reject_reason", r)


def department_rules(batch: DataFrame) -> DataFrame:
    return batch.withColumn("reject_reason", F.when(_missing("name"), "name_required"))


def user_rules(batch: DataFrame) -> DataFrame:
    r = (F.when(_missing("name"), "name_required").when(_missing("email"), "email_required")
         .when(~F.col("role").isin(*ROLES) | F.col("role").isNull(), "invalid_role"))
    return batch.withColumn("reject_reason", r)


def order_rules(orders: DataFrame) -> DataFrame:
    """An order needs at least one item and a method among cash/card/upi/wallet/credit."""
    r = (F.when(F.col("items").isNull() | (F.size("items") == 0), "items_required")
         .when(F.col("payment_method").isNull(), "payment_method_required")
         .when(~F.col("payment_method").isin(*ORDER_METHODS), "invalid_payment_method"))
    return orders.withColumn("reject_reason", r)


# ------------------------------------------------------------- D23 checks
CHECKS: dict[str, list[tuple[str, str]]] = {
    # The CHECK constraints of the model, as SQL predicates that must hold.
    "users": [("role_valid", f"role in ({', '.join(repr(x) for x in ROLES)})")],
    "products": [("price_non_negative", "price >= 0"), ("tax_rate_0_100", "tax_rate >= 0 and tax_rate <= 100"),
                 ("stock_non_negative", "stock_quantity >= 0")],
    "customers": [("points_non_negative", "loyalty_points >= 0"),
                  ("tier_valid", f"loyalty_tier in ({', '.join(repr(x) for x in TIERS)})")],
    "bills": [("total_non_negative", "total_amount >= 0"), ("net_non_negative", "net_amount >= 0"),
              ("method_valid", f"payment_method in ({', '.join(repr(x) for x in BILL_METHODS)})"),
              ("status_valid", f"status in ({', '.join(repr(x) for x in BILL_STATUSES)})")],
    "bill_items": [("quantity_positive", "quantity > 0")],
    "payments": [("status_valid", f"status in ({', '.join(repr(x) for x in PAYMENT_STATUSES)})")],
    "stock_adjustments": [("type_valid", f"type in ({', '.join(repr(x) for x in ADJUSTMENT_TYPES)})")],
}


def check_constraints(t, table: str) -> DataFrame:
    """(table, rule, violations) per CHECK rule; a NULL result passes, as in SQL."""
    df = t.table(table)
    rules = CHECKS[table]
    return df.agg(*[F.count(F.when(~F.expr(pred), 1)).alias(name) for name, pred in rules]).select(
        F.explode(F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("rule"),
                                     F.col(n).alias("violations")) for n, _ in rules])).alias("r")
    ).select("r.*")


UNIQUE: dict[str, list[str]] = {
    "departments": ["name"], "users": ["email"], "products": ["sku", "barcode"],
    "customers": ["email", "phone"], "bills": ["bill_number"],
}


def check_unique(t, table: str) -> DataFrame:
    """Values of a UNIQUE column held by more than one row (nulls ignored)."""
    df = t.table(table)
    parts = [df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
             .agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
             .select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "value", "rows")
             for c in UNIQUE[table]]
    return reduce(DataFrame.unionByName, parts)


FOREIGN_KEYS = [
    # Fixed values: (child table, column, parent table) for the 14 references of the model.
    ("departments", "manager_id", "users"), ("users", "department_id", "departments"),
    ("products", "department_id", "departments"), ("products", "supplier_id", "suppliers"),
    ("bills", "customer_id", "customers"), ("bills", "cashier_id", "users"),
    ("bill_items", "bill_id", "bills"), ("bill_items", "product_id", "products"),
    ("payments", "bill_id", "bills"), ("payments", "processed_by", "users"),
    ("returns", "bill_id", "bills"), ("returns", "cashier_id", "users"),
    ("stock_adjustments", "product_id", "products"), ("stock_adjustments", "adjusted_by", "users"),
]


def check_foreign_keys(t) -> DataFrame:
    """Per reference, the number of child rows whose non-null key has no parent.

    Each child table is read once: its keys become (reference, parent, key)
    rows, reduced with a map-side-combinable count, so a hot key (e.g. one product on a third of
    all lines) costs one row; then one anti-join on (parent, key) checks all references."""
    spark = t.spark
    refs_of: dict[str, list[tuple[int, str, str]]] = {}
    for i, (child, col, parent) in enumerate(FOREIGN_KEYS):
        refs_of.setdefault(child, []).append((i, col, parent))
    keys = reduce(DataFrame.unionByName, [
        t.table(child).select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("_ref"), F.lit(parent).alias("_parent"), F.col(col).cast("bigint").alias("_k"))
            for i, col, parent in refs])).alias("_r")).select("_r.*").filter(F.col("_k").isNotNull())
        .groupBy("_ref", "_parent", "_k").agg(F.count(F.lit(1)).alias("_n")) for child, refs in refs_of.items()])
    ids = reduce(DataFrame.unionByName, [t.table(p).select(F.lit(p).alias("_parent"), F.col("id").cast("bigint").alias("_k"))
                                         for p in sorted({p for _, _, p in FOREIGN_KEYS})])
    orphans = keys.join(ids, ["_parent", "_k"], "left_anti").groupBy("_ref").agg(F.sum("_n").alias("_orphans"))
    # The reference list itself (metadata), so references without orphans report 0.
    refs = spark.createDataFrame([(i, c, col, p) for i, (c, col, p) in enumerate(FOREIGN_KEYS)],
                                 "_ref int, table_name string, column_name string, parent_table string")
    return refs.join(orphans, "_ref", "left").select(
        "table_name", "column_name", "parent_table",
        F.coalesce(F.col("_orphans"), F.lit(0)).cast("bigint").alias("orphans"))
