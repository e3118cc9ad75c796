"""S5 + A3: order intake — JSON order requests to priced, committed bills.

Requests arrive as JSON lines; each micro-batch (``foreachBatch``) parses them
(text lines through ``from_json``, PERMISSIVE; malformed bodies are rejected),
applies the order rules (D22c), refuses orders naming an unknown product,
prices the lines (D1), totals the bills (D2) and commits bills, lines and
rejects as one version of a store per batch id (A5, ``streaming.store``).  A duplicated request id is taken
once, in any batch: the stream's state holds every key seen.  A replayed batch id changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.integrity import order_rules
from tillroll.operators.ledger import bill_totals, price_lines
from tillroll.plans.spread import rows_read
from tillroll.session import checkpointed
from tillroll.streaming.sinks import scratch
from tillroll.streaming.store import Append, Replace, Store, Update

ORDER_SCHEMA = ("request_id bigint, customerId bigint, paymentMethod string, discountAmount decimal(12,2), "
                "items array<struct<productId:bigint,quantity:int,discount:decimal(12,2)>>, "
                "created_at timestamp_ntz, _corrupt_record string")


#: Requests in a file of the derived workload: micro-batches hold more of them, and are few.
REQUESTS_PER_FILE, LEAST_FILES = 500_000, 8


def request_files(t) -> int:
    """How many files the derived requests are written to: as their number asks, not the partitions of a shuffle."""
    return max(LEAST_FILES, -(-rows_read(t.bills) // REQUESTS_PER_FILE))


def order_requests_json(t, keep_id: bool = False, parts: int | None = None) -> DataFrame:
    """A request per bill, as JSON text: header fields plus the bill's lines.  ``parts``: the partitions they are made in.

    The workload also holds broken bodies, for every bill in whose id 97 goes
    without a rest one more line that ends after 40 characters."""
    lines = t.bill_items.select("bill_id", "product_id", "quantity", "discount")
    lines = lines.repartition(parts, "bill_id") if parts else lines
    items = lines.groupBy(F.col("bill_id").alias("_bid")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("product_id").alias("productId"), F.col("quantity").alias("quantity"),
        F.col("discount").alias("discount")))).alias("items"))
    b = t.bills.repartition(parts, "id") if parts else t.bills
    j = b.join(items, b.id == items._bid, "left")
    body = F.to_json(F.struct(F.col("id").alias("request_id"), F.col("customer_id").alias("customerId"),
                              F.col("payment_method").alias("paymentMethod"),
                              F.col("discount_amount").alias("discountAmount"), "items", "created_at"))
    out = j.select(body.alias("value"), F.col("id").alias("_id"))
    broken = F.when(F.col("_id") % 97 == 0, F.array("value", F.substring("value", 1, 40))).otherwise(F.array("value"))
    out = out.select(F.explode(broken).alias("value"), "_id")
    return out if keep_id else out.select("value")


def parsed(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) as order columns, PERMISSIVE, with ``_key``: what makes a request one request.

    That is its id, or for a body without one its text's hash.  ``_broken``: the body is no JSON object.  The text itself
    goes no further: it would be shuffled with every order."""
    fields = F.from_json("value", ORDER_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("value", fields.alias("_o")).select("value", "_o.*")
    rows = rows.withColumn("_key", F.coalesce(F.when(F.col("_corrupt_record").isNull(), F.col("request_id").cast("string")),
                                              F.sha2(F.coalesce("value", F.lit("")).cast("binary"), 256)))
    broken = F.col("_corrupt_record").isNotNull() | F.coalesce(F.trim("value") == "", F.lit(True))
    return rows.withColumn("_broken", broken).drop("value", "_corrupt_record")


def parse_orders(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: (well-formed orders, rejects of the others) from ``parsed`` lines.

    A body that is no JSON object is ``malformed_json``, one without an id ``request_id_missing``."""
    broken = F.col("_broken")
    bad = raw.filter(broken | F.col("request_id").isNull()).select(
        F.lit(None).cast("bigint").alias("request_id"),
        F.when(broken, "malformed_json").otherwise("request_id_missing").alias("reject_reason"))
    ok = raw.filter(~broken & F.col("request_id").isNotNull()).select(
        "request_id", F.col("customerId").alias("customer_id"), F.col("paymentMethod").alias("payment_method"),
        F.coalesce("discountAmount", F.lit(0).cast("decimal(12,2)")).alias("discount_amount"), "items", "created_at")
    return ok, bad


def negative_totals(bills: DataFrame) -> DataFrame:
    """Rejects of the priced bills whose net or total is below zero (the model forbids them)."""
    return bills.filter((F.col("net_amount") < 0) | (F.col("total_amount") < 0)).select(
        F.col("bill_id").alias("request_id"), F.lit("negative_total").alias("reject_reason"))


def process_orders(orders: DataFrame, products: DataFrame, cut=lambda df: df) -> dict[str, DataFrame]:
    """One batch of parsed orders -> {bills, bill_items, refused_bills, rejects}.

    ``refused_bills``: the priced totals of orders that are refused for a negative total.
    ``cut`` is applied to the priced lines and totals, from which several tables are made."""
    checked = order_rules(orders)
    rejects = checked.filter(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason")
    ok = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    lines = ok.select(F.col("request_id").alias("bill_id"), F.explode("items").alias("it")).select(
        "bill_id", F.col("it.productId").alias("product_id"), F.col("it.quantity").alias("quantity"),
        F.col("it.discount").alias("discount"))
    known = products.select(F.col("id").alias("product_id"))
    unknown = lines.join(known, "product_id", "left_anti").select(F.col("bill_id").alias("request_id")).distinct()
    bad_quantity = (lines.filter(F.coalesce(F.col("quantity") <= 0, F.lit(True))).select(F.col("bill_id").alias("request_id"))
                    .distinct().join(unknown, "request_id", "left_anti"))
    rejects = (rejects.unionByName(unknown.withColumn("reject_reason", F.lit("product_not_found")))
               .unionByName(bad_quantity.withColumn("reject_reason", F.lit("quantity_not_positive"))))
    unknown = unknown.unionByName(bad_quantity)
    lines = lines.join(unknown.select(F.col("request_id").alias("bill_id")), "bill_id", "left_anti")
    priced = cut(price_lines(lines, products))
    headers = ok.join(unknown, "request_id", "left_anti").select(F.col("request_id").alias("id"), "discount_amount")
    bills = cut(bill_totals(priced, headers))
    negative = negative_totals(bills)
    refused = negative.select(F.col("request_id").alias("bill_id"))
    return {"bills": bills.join(refused, "bill_id", "left_anti"), "bill_items": priced.join(refused, "bill_id", "left_anti"),
            "refused_bills": bills.join(refused, "bill_id", "left_semi"), "rejects": rejects.unionByName(negative)}


def _request_files(spark: SparkSession, t, path: str) -> str:
    """The derived requests as text files, written where bills and lines meet: the bodies are not shuffled."""
    order_requests_json(t, parts=request_files(t)).write.text(path)
    return path


def run_intake(spark: SparkSession, t, requests_dir: str | None = None, max_files: int = 4, root: str | None = None) -> str:
    """Run the intake stream over JSON request files until drained; returns the root of its commits.

    A request id (or, without one, a body) counts once, however the files fall
    into micro-batches: the stream's own state holds every key seen, without a time limit, so no
    request is late.  A run with the ``root`` of an earlier one goes on where that stopped."""
    if root is None:
        root = scratch(spark, "s05-intake")
    if requests_dir is None:
        requests_dir = _request_files(spark, t, f"{root}/requests")
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(requests_dir)
    products, store = t.products, Store(spark, root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # several tables are written from one micro-batch: read and parse it once
        with _held(spark, batch) as held:
            orders, bad = parse_orders(held)
            out = process_orders(orders, products, _cut)
            out["rejects"] = out["rejects"].unionByName(bad)
            store.write({n: Append(df) for n, df in out.items()}, batch_id)

    q = (parsed(lines).dropDuplicates(["_key"]).writeStream.foreachBatch(handle)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return root


def committed_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A committed table over all batches of a run."""
    return Store(spark, root).read(table)


def priced_rows(spark: SparkSession, root: str) -> DataFrame:
    """The totals of every order that a run priced: those committed as bills, and those refused for what they come to."""
    store = Store(spark, root)
    return store.read("bills").unionByName(store.read("refused_bills"))


def parse_and_check(spark: SparkSession, t) -> DataFrame:
    """A3 + D22c in batch: the derived JSON requests read back, with
    every refused request and its reason (malformed, no items, bad method,
    unknown product)."""
    raw = parsed(spark.read.text(_request_files(spark, t, scratch(spark, "a03-requests")))).dropDuplicates(["_key"])
    orders, bad = parse_orders(raw)
    return process_orders(orders, t.products)["rejects"].unionByName(bad)


def write_requests_in_time_order(t, out: str, files: int | None = None) -> str:
    """Write the derived JSON requests, cut into ranges of their time (none first), one file per range.

    The file source takes files by modification time; these are set in the order of the ranges, a
    second apart.  Within a micro-batch admission orders the requests by their own time."""
    spark = t.spark
    n = files or request_files(t)
    order = [F.col("created_at").asc_nulls_first(), F.col("value")]
    order_requests_json_with_time(t).repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.text(out)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath().getName(), s) for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
    if parts:
        first = min(s.getModificationTime() for _, s in parts) - 1000 * len(parts)
        for i, (_, s) in enumerate(parts):
            fs.setTimes(s.getPath(), first + 1000 * i, -1)
    return out


def order_requests_json_with_time(t) -> DataFrame:
    """``order_requests_json`` plus the bill time, by which the files are cut."""
    b = t.bills.select(F.col("id").alias("_id"), "created_at")
    j = order_requests_json(t, keep_id=True)
    return j.join(b, j._id == b._id).drop("_id")


# ----------------------------------------------------------------- full checkout
@contextmanager
def _held(spark: SparkSession, batch: DataFrame) -> Iterator[DataFrame]:
    """A micro-batch's requests, written once in the shared checkpoint folder and read by ``spark``; the files go at the end.

    The many passes over a batch would each work out the stream's state anew: Spark does not find a persisted batch in the sides of a
    join.  And every task of theirs would report a metric for each part of the state, the square of the shuffle partitions in all, to the
    driver.  The stream's own session runs without adaptive execution, so a task for every shuffle partition; ``spark`` has it."""
    path = scratch(spark, "s05-batch")
    try:
        batch.drop("_key").coalesce(2 * spark.sparkContext.defaultParallelism).write.parquet(path)
        yield spark.read.schema(batch.drop("_key").schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _cut(df: DataFrame) -> DataFrame:
    """``df`` worked out once, in the shared checkpoint folder: several tables are made from it."""
    return checkpointed(df)


def checkout_batch(orders: DataFrame, products: DataFrame, customers: DataFrame, start_seq: int
                   ) -> tuple[dict[str, DataFrame], int]:
    """One batch of parsed orders through the whole billing path.

    Order rules (D22c), unknown customer (FK) and negative totals (CHECK)
    depend on the bill alone and are refused first, so they never hold
    stock; then bills are admitted against stock in arrival order, all or
    nothing (D4); admitted bills are priced (D1), totalled (D2), numbered
    from the running sequence (D3), and stock (D5) and loyalty (D6/D7) are
    updated.  Returns the rows to add (bills, bill_items, rejects), the changed columns of
    products and customers, and the next sequence number."""
    from tillroll.operators.ledger import accrue_loyalty, apply_sales, bill_numbers
    from tillroll.plans.admission import admit_bills

    checked = order_rules(orders)
    rejects = checked.filter(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason")
    ok = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    known_c = customers.select(F.col("id").alias("_cid"))
    no_customer = (ok.filter(F.col("customer_id").isNotNull())
                   .join(known_c, F.col("customer_id") == F.col("_cid"), "left_anti")
                   .select("request_id", F.lit("customer_not_found").alias("reject_reason")))
    ok = ok.join(no_customer.select("request_id"), "request_id", "left_anti")
    lines = ok.select(F.col("request_id").alias("bill_id"), "created_at", F.explode("items").alias("it")).select(
        "bill_id", "created_at", F.col("it.productId").alias("product_id"), F.col("it.quantity").alias("quantity"),
        F.col("it.discount").alias("discount"))
    priced = _cut(price_lines(lines.drop("created_at"), products))
    totals = _cut(bill_totals(priced, ok.select(F.col("request_id").alias("id"), "discount_amount")))
    negative = negative_totals(totals)
    cand = lines.join(negative.select(F.col("request_id").alias("bill_id")), "bill_id", "left_anti")
    stock = products.select(F.col("id").alias("product_id"), F.col("stock_quantity").alias("stock"))
    decided = admit_bills(cand.select("bill_id", "product_id", "quantity", "created_at"), stock)
    refused = decided.filter(~F.col("accepted")).select(F.col("bill_id").alias("request_id"), "reject_reason")
    rejects = rejects.unionByName(no_customer).unionByName(negative).unionByName(refused)
    admitted = decided.filter(F.col("accepted")).select("bill_id")
    head = ok.select(F.col("request_id").alias("bill_id"), "customer_id", "payment_method", "created_at")
    acc = admitted.join(head, "bill_id").join(totals, "bill_id")
    numbered = bill_numbers(acc.select(F.col("bill_id").alias("id"), "created_at"), start_seq)
    n_accepted = numbered.count()
    bills = _cut(acc.join(numbered.select(F.col("id").alias("bill_id"), "bill_number"), "bill_id").select(
        F.col("bill_id").alias("id"), "bill_number", "customer_id", F.lit(None).cast("int").alias("cashier_id"),
        F.col("total_amount").cast("decimal(12,2)").alias("total_amount"),
        F.col("discount_amount").cast("decimal(12,2)").alias("discount_amount"),
        F.col("tax_amount").cast("decimal(12,2)").alias("tax_amount"),
        F.col("net_amount").cast("decimal(12,2)").alias("net_amount"), "payment_method",
        F.lit("completed").alias("status"), "created_at"))
    items = priced.join(admitted, "bill_id", "left_semi")
    stock_after = apply_sales(products, items).filter("changed").select("id", "stock_quantity")
    loyalty = accrue_loyalty(customers, bills).filter("changed").select("id", "loyalty_points", "total_purchases", "loyalty_tier")
    out = {"bills": bills, "bill_items": items, "rejects": rejects, "products": stock_after, "customers": loyalty}
    return out, start_seq + n_accepted


def run_checkout(spark: SparkSession, t, requests_dir: str | None = None, max_files: int = 4, root: str | None = None) -> str:
    """S5 full path: the intake stream where every micro-batch continues from the
    store's newest version (stock, loyalty, bill sequence) and writes the next one.

    A batch reads the products and customers that its orders name, and only files that hold
    one whose stock or points change are written anew; bills, lines and rejects are added.  Request ids seen in any earlier batch are
    dropped by the stream's own state.  A replayed batch changes nothing, and a run with the ``root`` of an earlier
    one goes on where that stopped.  Returns the store's root."""
    if root is None:
        root = scratch(spark, "s05-checkout")
    if requests_dir is None:
        requests_dir = write_requests_in_time_order(t, f"{root}/requests")
    store = Store(spark, root)
    if store.latest() is None:
        store.write({"products": Replace(t.products, "id"), "customers": Replace(t.customers, "id")}, meta={"next_seq": 1})
    raw = parsed(spark.readStream.option("maxFilesPerTrigger", max_files).text(requests_dir))

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = store.describe()
        if now["batch"] is not None and now["batch"] >= batch_id:
            return
        with _held(spark, batch) as held:
            orders, bad = parse_orders(held)
            products = _cut(store.lookup("products", orders.select(F.explode("items.productId").alias("id"))))
            customers = _cut(store.lookup("customers", orders.select(F.col("customer_id").alias("id"))))
            out, next_seq = checkout_batch(orders, products, customers, now["meta"]["next_seq"])
            out["rejects"] = out["rejects"].unionByName(bad)
            changes = {n: Append(out[n]) for n in ("bills", "bill_items", "rejects")}
            store.write(changes | {n: Update(out[n]) for n in ("products", "customers")}, batch_id, {"next_seq": next_seq})

    q = (raw.dropDuplicates(["_key"]).writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return root


def checkout_bills(spark: SparkSession, t) -> DataFrame:
    """The bills committed by a full checkout run over the derived requests."""
    return committed_rows(spark, run_checkout(spark, t), "bills")
