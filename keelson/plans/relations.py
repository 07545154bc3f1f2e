"""Queries over point and range access, mutations, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import access, aggregates, joins, mutate
from keelson.plans.tables import Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("kv_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def _(t: Tables):
    return access.point_lookup(t.customer, {"c_custkey": 77}, ["c_custkey", "c_name", "c_acctbal"])


@add("kv_batch_lookup_miss", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return access.batch_lookup(t.labels.select("doc_id", "quality"), t.documents.select("doc_id"), ["doc_id"])


@add("scan_asc_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 200 AND 700")
def _(t):
    return access.scan(t.orders, ["o_orderkey"], [200], [700]).select("o_orderkey", "o_custkey")


@add("scan_desc_range", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders WHERE o_orderkey <= 500 ORDER BY o_orderkey DESC LIMIT 25")
def _(t):
    from pyspark.sql import Window as W

    top = access.scan(t.orders, ["o_orderkey"], high=[500], descending=True).limit(25)
    return top.select("o_orderkey", "o_custkey", F.row_number().over(W.orderBy(F.desc("o_orderkey"))).cast("long").alias("place"))


@add("scan_composite_range", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_orderkey > 100 OR l_orderkey = 100 AND l_linenumber >= 3) AND (l_orderkey < 180 OR l_orderkey = 180 AND l_linenumber <= 2) GROUP BY ALL")
def _(t):
    rows = access.scan(t.lineitem, ["l_orderkey", "l_linenumber"], [100, 3], [180, 2])
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@add("scan_take_while", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE NOT o_totalprice < 480000), 9223372036854775807)")
def _(t):
    return access.take_while(t.orders, ["o_orderkey"], F.col("o_totalprice") < 480000).select("o_orderkey", "o_totalprice")


@add("prefix_scan_lines", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 33")
def _(t):
    return access.prefix_scan(t.lineitem, ["l_orderkey", "l_linenumber"], [33]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@add("count_entries", "SELECT count(*) AS entries FROM lineitem")
def _(t):
    return access.count_entries(t.lineitem)


@add("not_empty", "SELECT count(*) > 0 AS not_empty FROM region")
def _(t):
    return access.not_empty(t.region)


@add("size_in_pages", "SELECT b AS bytes, CAST(ceil(b / 4096.0) AS BIGINT) AS pages FROM (SELECT CAST(sum(octet_length(encode(CAST(r_regionkey AS VARCHAR))) + octet_length(encode(r_name))) AS BIGINT) AS b FROM region)")
def _(t):
    return access.size_in_pages(t.region)


@add("latest_order_per_customer", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def _(t):
    return access.latest(t.orders, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_totalprice"])


_BY_NATION = "SELECT c_nationkey, {f}(o_orderkey) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_nationkey"


def _open_orders(t: Tables):
    return t.orders.where("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))


@add("oldest_open_order", _BY_NATION.format(f="min"))
def _(t):
    return access.earliest(_open_orders(t), ["c_nationkey"], ["o_orderkey"], ["o_orderkey"])


@add("newest_open_order", _BY_NATION.format(f="max"))
def _(t):
    return access.latest(_open_orders(t), ["c_nationkey"], ["o_orderkey"], ["o_orderkey"])


def _new_customers(t: Tables):
    """Requests with some keys present, some absent and some twice."""
    rows = t.orders.select((F.col("o_custkey") * 3).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    return rows


_NEW = "(SELECT o_custkey * 3 AS c_custkey, o_totalprice AS c_acctbal, o_orderkey AS seq FROM orders)"


@add("insert_if_absent", f"SELECT c_custkey, c_acctbal, CAST(NULL AS BIGINT) AS seq FROM customer UNION ALL SELECT c_custkey, arg_min(c_acctbal, seq), min(seq) FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = n.c_custkey) GROUP BY c_custkey")
def _(t):
    base = t.customer.select("c_custkey", "c_acctbal", F.lit(None).cast("long").alias("seq"))
    return mutate.insert_if_absent(base, _new_customers(t), ["c_custkey"], ["seq"])


@add("update_if_present", f"SELECT c.c_custkey, c.c_name, coalesce(u.v, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN (SELECT c_custkey, max(c_acctbal) AS v FROM {_NEW} GROUP BY c_custkey) u ON c.c_custkey = u.c_custkey")
def _(t):
    updates = _new_customers(t).groupBy("c_custkey").agg(F.max("c_acctbal").alias("c_acctbal"))
    return mutate.update_if_present(t.customer.select("c_custkey", "c_name", "c_acctbal"), updates, ["c_custkey"])


@add("rmw_in_place", "SELECT c_custkey, round(c_acctbal + coalesce(d, 0), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS d FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(t):
    deltas = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    out = mutate.modify(t.customer.select("c_custkey", "c_acctbal"), deltas, ["c_custkey"], {"c_acctbal": "o_totalprice"})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@add("erase", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return mutate.erase(t.customer, gone, ["c_custkey"]).select("c_custkey", "c_name")


@add("erase_flags", "SELECT k AS c_custkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = k) AS erased FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders)")
def _(t):
    gone = t.orders.select((F.col("o_custkey") * 2).alias("c_custkey"))
    return mutate.erased(t.customer, gone, ["c_custkey"])


@add("range_delete", "SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT o_custkey, max(o_orderkey) AS h FROM orders GROUP BY o_custkey) m ON o.o_custkey = m.o_custkey WHERE o.o_orderkey > h - 5000")
def _(t):
    return mutate.retain_window(t.orders, ["o_custkey"], "o_orderkey", 5000).select("o_orderkey", "o_custkey")


@add("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t):
    rich = t.orders.where("o_totalprice > 300000")
    return t.customer.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@add("anti_join", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@add("outer_join", "SELECT coalesce(c_custkey, k) AS k, c_custkey IS NOT NULL AS known, n FROM customer FULL JOIN (SELECT o_custkey + 100 AS k, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = k")
def _(t):
    orders = t.orders.groupBy((F.col("o_custkey") + 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = t.customer.select("c_custkey").join(orders, F.col("c_custkey") == F.col("k"), "full")
    return joined.select(F.coalesce("c_custkey", "k").alias("k"), F.col("c_custkey").isNotNull().alias("known"), "n")


@add("asof_latest", "SELECT e.event_id, e.user_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'")
def _(t):
    history = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    probes = t.events.where("event_type = 'view'").select("user_id", "ts", "event_id")
    return joins.as_of(probes, history, ["user_id"], "ts", ["purchase_id"], ["purchase_id"]).select("event_id", "user_id", "purchase_id")


@add("content_join", "SELECT d.doc_id, i.first FROM documents d JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) i ON d.text = i.text")
def _(t):
    firsts = t.documents.groupBy(F.col("text").alias("content")).agg(F.min("doc_id").alias("first"))
    return joins.content_join(t.documents.select("doc_id", "text"), firsts, "text", "content").select("doc_id", "first")


@add("high_water_marks", "SELECT o_custkey, max(o_orderkey) AS max_order, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS max_delivered FROM orders GROUP BY o_custkey")
def _(t):
    orders = t.orders.withColumn("d", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return aggregates.high_water_marks(orders, ["o_custkey"], {"max_order": "o_orderkey", "max_delivered": "d"})


@add("distinct_below", "SELECT l_suppkey, count(DISTINCT CASE WHEN l_quantity < 10 THEN l_partkey END) AS low FROM lineitem GROUP BY l_suppkey")
def _(t):
    return aggregates.distinct_below(t.lineitem, ["l_suppkey"], "l_partkey", F.col("l_quantity") < 10, "low")


@add("weighted_mean_update", "SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 6) AS mean FROM lineitem GROUP BY l_partkey")
def _(t):
    return aggregates.weighted_mean(t.lineitem, ["l_partkey"], "l_extendedprice", "l_quantity", "mean")


@add("histogram_buckets", "SELECT CAST(least(greatest(floor((o_totalprice - 10000) / ((400000 - 10000) / 20.0)), 0), 19) AS INTEGER) AS bucket, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def _(t):
    return aggregates.histogram(t.orders, "o_totalprice", 10000, 400000, 20)


@add("histogram_percentiles", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type")
def _(t):
    return aggregates.percentiles(t.events, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p999": 0.999})


@add("generation_stats", "SELECT least(o_orderkey % 31, 19) AS generation, count(*) AS blocks, sum(o_custkey) AS fill, min(o_custkey) AS least_valid FROM orders GROUP BY 1")
def _(t):
    rows = t.orders.withColumn("g", F.col("o_orderkey") % 31).withColumn("v", F.col("o_custkey"))
    return aggregates.generations(rows, "g", "o_custkey", "v")


@add("access_frequency", "SELECT n, count(*) AS pages FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("pages"))


@add("cube_sales", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@add("rollup_sales", "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def _(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@add("grouping_sets_sales", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(t):
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@add("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@add("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_partkey FROM lineitem")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.lineitem.select("l_partkey"))


@add("set_except", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("k")).exceptAll(t.customer.select("c_custkey"))


@add("distinct_sorted", "SELECT DISTINCT l_shipdate AS d, l_returnflag AS f FROM lineitem")
def _(t):
    return t.lineitem.select(F.col("l_shipdate").alias("d"), F.col("l_returnflag").alias("f")).distinct().orderBy("d", "f")


@add("top_k_smallest", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 8")
def _(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey").limit(8)


@add("budgeted_top_k", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, coalesce(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM customer WHERE c_acctbal > 0) WHERE b < 20000")
def _(t):
    rows = t.customer.where("c_acctbal > 0").select("c_nationkey", "c_custkey", "c_acctbal")
    return aggregates.within_budget(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], "c_acctbal", 20000)


@add("random_rows", "SELECT p_partkey, p_name FROM part ORDER BY md5('3:' || p_partkey), p_partkey LIMIT 20")
def _(t):
    return aggregates.sample_rows(t.part.select("p_partkey", "p_name"), "p_partkey", 20, seed=3)


@add("record_callback", "SELECT p_partkey, p_size * 2 AS p_size FROM part")
def _(t):
    return access.map_records(t.part.select("p_partkey", "p_size"), lambda part: part.assign(p_size=part.p_size * 2), "p_partkey long, p_size int")
