"""Order-processing and web-style workload programs over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import scalar
from keelson.operators import access, blob, mutate, orders
from keelson.plans.tables import Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.add


def placed(t: Tables):
    """Orders with their customer's nation as the warehouse."""
    return t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")


_PLACED = "(SELECT o.*, c_nationkey FROM orders o JOIN customer ON o_custkey = c_custkey)"
_STOCK = "(SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@add(
    "stock_level",
    f"SELECT c_nationkey, count(*) AS low_stock FROM (SELECT DISTINCT c_nationkey, l.l_suppkey, l.l_partkey FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey DESC) AS r FROM {_PLACED}) o JOIN lineitem l ON l_orderkey = o_orderkey WHERE r <= 20) i JOIN {_STOCK} s ON i.l_suppkey = s.l_suppkey AND i.l_partkey = s.l_partkey WHERE q < 40 GROUP BY c_nationkey",
)
def stock_level(t: Tables):
    stock = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return orders.stock_level(placed(t), lines, stock, ["c_nationkey"], "o_orderkey", ["l_suppkey", "l_partkey"], "q", 40)


@add("order_status_lines", "SELECT o_custkey, l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) ON l_orderkey = k")
def _(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return orders.order_status(t.orders, lines, ["o_custkey"], "o_orderkey", ["l_linenumber", "l_partkey", "l_quantity"]).select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@add("customer_median_by_name", "SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE r = (n - 1) // 2 + 1")
def _(t):
    return orders.customers_by_name(t.customer, ["c_nationkey", "c_mktsegment"], "c_name", "c_custkey")


@add("line_amount", "SELECT l_orderkey, CAST(sum(CAST(round(l_quantity * p_retailprice * (1 + l_tax + 0.05) * (1 - l_discount), 6) AS DECIMAL(20, 6))) AS DOUBLE) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey")
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    amount = scalar.line_amount(F.col("l_quantity"), F.col("p_retailprice"), taxes=[F.col("l_tax"), F.lit(0.05)], discount=F.col("l_discount"))
    return joined.groupBy("l_orderkey").agg(F.sum(F.round(amount, 6).cast("decimal(20,6)")).cast("double").alias("amount"))


@add("all_local", "SELECT l_orderkey, bool_and(s_nationkey = c_nationkey) AS all_local FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_orderkey")
def _(t):
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(placed(t), F.col("l_orderkey") == F.col("o_orderkey"))
    return orders.all_local(lines, "l_orderkey", F.col("c_nationkey"), F.col("s_nationkey"))


@add("payment_totals", "SELECT c_nationkey, o_custkey, round(sum(o_totalprice), 2) AS ytd, round(-sum(o_totalprice), 2) AS balance, count(*) AS payments FROM " + _PLACED + " GROUP BY ALL")
def _(t):
    totals = orders.payment_totals(placed(t), ["c_nationkey", "o_custkey"], "o_totalprice")
    return totals.withColumns({"ytd": F.round("ytd", 2), "balance": F.round("balance", 2)})


@add("history_ids", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderdate, o_orderkey) AS h_pk FROM orders")
def _(t):
    payments = t.orders.withColumn("worker", F.col("o_custkey") % 8)
    return orders.payment_history(payments, "worker", ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("h_pk").cast("long").alias("h_pk"))


@add("assign_order_ids", "SELECT o_orderkey, c_nationkey, 3001 + c_nationkey + row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) - 1 AS o_id FROM " + _PLACED)
def _(t):
    districts = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") + 3001).alias("next"))
    numbered, _ = orders.new_orders(placed(t), districts, ["c_nationkey"], ["o_orderdate", "o_orderkey"], "next")
    return numbered.select("o_orderkey", "c_nationkey", F.col("o_id").cast("long").alias("o_id"))


@add("district_next_ids", "SELECT n_nationkey AS c_nationkey, 3001 + n_nationkey + coalesce(n, 0) AS next FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM " + _PLACED + " GROUP BY 1) ON n_nationkey = k")
def _(t):
    districts = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") + 3001).alias("next"))
    return orders.new_orders(placed(t), districts, ["c_nationkey"], ["o_orderkey"], "next")[1]


_DELIVERY = "SELECT c_nationkey, o_orderkey, o_custkey, round(coalesce(credit, 0), 2) AS credit FROM (SELECT c_nationkey, {pick}(o_orderkey) AS o_orderkey, arg_{pick}(o_custkey, o_orderkey) AS o_custkey FROM " + _PLACED + " WHERE o_orderstatus = 'O' GROUP BY 1) LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS credit FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


def _deliver(t: Tables, pick: str):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    out = orders.delivery(placed(t).where("o_orderstatus = 'O'"), lines, ["c_nationkey"], "o_orderkey", "o_custkey", F.col("l_extendedprice"), pick)
    return out.select("c_nationkey", "o_orderkey", "o_custkey", F.round("credit", 2).alias("credit"))


@add("delivery_credit", _DELIVERY.format(pick="min"))
def _(t):
    return _deliver(t, "oldest")


@add("delivery_credit_newest", _DELIVERY.format(pick="max"))
def _(t):
    return _deliver(t, "newest")


@add("delivered_balances", "SELECT c_custkey, round(c_acctbal + coalesce(d, 0), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, sum(credit) AS d FROM (" + _DELIVERY.format(pick="min") + ") GROUP BY 1) ON c_custkey = o_custkey")
def _(t):
    credits = _deliver(t, "oldest").select(F.col("o_custkey").alias("c_custkey"), "credit")
    out = mutate.modify(t.customer.select("c_custkey", "c_acctbal"), credits, ["c_custkey"], {"c_acctbal": "credit"})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@add("batch_delete", "SELECT o.c_nationkey, o.o_orderkey FROM " + _PLACED + " o JOIN (SELECT c_nationkey AS k, max(o_orderkey) AS h, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS op FROM " + _PLACED + " GROUP BY 1) ON c_nationkey = k WHERE o_orderkey <= h - 100 AND coalesce(o_orderkey < op, TRUE)")
def _(t):
    return orders.delivered_beyond(placed(t), ["c_nationkey"], "o_orderkey", F.col("o_orderstatus") != "P", 100).select("c_nationkey", "o_orderkey")


@add("stock_order_fold", "WITH RECURSIVE l AS (SELECT l_suppkey, l_partkey, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS r FROM lineitem), f AS (SELECT l_suppkey, l_partkey, r, CASE WHEN 60 >= q + 10 THEN 60 - q ELSE 60 + 91 - q END AS s FROM l WHERE r = 1 UNION ALL SELECT l.l_suppkey, l.l_partkey, l.r, CASE WHEN f.s >= l.q + 10 THEN f.s - l.q ELSE f.s + 91 - l.q END FROM f JOIN l ON l.l_suppkey = f.l_suppkey AND l.l_partkey = f.l_partkey AND l.r = f.r + 1) SELECT l_suppkey, l_partkey, arg_max(s, r) AS stock FROM f GROUP BY 1, 2")
def _(t):
    requests = t.lineitem.withColumn("q", F.col("l_quantity").cast("int"))
    base = requests.select("l_suppkey", "l_partkey").distinct().withColumn("stock", F.lit(60))
    return mutate.fold(base, requests, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber", "q"], "q", "stock", scalar.replenish)


@add("mix_histogram", "SELECT CASE WHEN d < 43 THEN 'payment' WHEN d < 47 THEN 'status' WHEN d < 51 THEN 'delivery' WHEN d < 55 THEN 'stock' ELSE 'neworder' END AS kind, count(*) AS n FROM (SELECT event_id * 37 % 100 AS d FROM events) GROUP BY 1")
def _(t):
    shares = [("payment", 43), ("status", 4), ("delivery", 4), ("stock", 4), ("neworder", 45)]
    mixed = orders.transaction_mix(t.events, F.col("event_id") * 37 % 100, shares)
    return mixed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@add("kv_read_update", "SELECT c_custkey, CASE WHEN max(u) IS NOT NULL THEN max(u) ELSE c_name END AS payload, count(r) AS reads FROM customer LEFT JOIN (SELECT user_id AS k, CASE WHEN event_id % 5 = 0 THEN event_type END AS u, CASE WHEN event_id % 5 <> 0 THEN 1 END AS r FROM events) ON k = c_custkey GROUP BY c_custkey, c_name")
def _(t):
    keyed = t.events.select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    updates = keyed.where("event_id % 5 = 0").groupBy("c_custkey").agg(F.max("event_type").alias("payload"))
    base = t.customer.select("c_custkey", F.col("c_name").alias("payload"))
    changed = mutate.update_if_present(base, updates, ["c_custkey"])
    reads = keyed.where("event_id % 5 <> 0").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("reads"))
    return changed.join(reads, "c_custkey", "left").withColumn("reads", F.coalesce("reads", F.lit(0)))


@add("web_log_append", "SELECT user_id, sha256(string_agg(event_type, '' ORDER BY event_id)) AS log, count(*) AS appends FROM events GROUP BY user_id")
def _(t):
    grown = blob.append(t.events, ["user_id"], ["event_id"], "event_type")
    return grown.select("user_id", blob.digest("content").alias("log"), "appends")


@add("popular_pages", "SELECT page_id, octet_length(encode(html)) AS size, coalesce(n, 0) AS views FROM pages LEFT JOIN (SELECT event_id % 250 AS k, count(*) AS n FROM events GROUP BY 1) ON page_id = k")
def _(t):
    views = t.events.groupBy((F.col("event_id") % 250).alias("page_id")).agg(F.count(F.lit(1)).alias("views"))
    found = access.batch_lookup(views, t.pages.select("page_id", F.octet_length(F.col("html").cast("binary")).cast("long").alias("size")), ["page_id"])
    return found.select("page_id", "size", F.coalesce("views", F.lit(0)).alias("views"))


@add("aging_survivors", "SELECT doc_id, octet_length(encode(text)) AS size FROM documents WHERE doc_id % 5 <> 4 OR doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    gone = t.labels.where("doc_id % 5 = 4")
    kept = mutate.erase(t.documents, gone, ["doc_id"])
    return kept.select("doc_id", F.octet_length(F.col("text").cast("binary")).cast("long").alias("size"))


@add("order_totals_by_month", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    return t.orders.groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
