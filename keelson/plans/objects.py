"""Queries over large objects, generated values and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import scalar
from keelson.operators import blob, joins
from keelson.operators.running import running_total
from keelson.plans.tables import Catalogue, Tables

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("blob_describe", "SELECT doc_id, hex(encode(text)[1:32]) AS prefix, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents WHERE octet_length(encode(text)) > 0")
def _(t: Tables):
    return blob.describe(t.documents, "doc_id", "text")


@add("blob_partial_load", "SELECT doc_id, least(octet_length(encode(text)), 4096) AS size, sha256(encode(text)[1:4096]) AS digest FROM documents")
def _(t):
    part = t.documents.select("doc_id", blob.load("text").alias("part"))
    return part.select("doc_id", F.octet_length("part").cast("long").alias("size"), F.sha2("part", 256).alias("digest"))


@add("blob_read_range", "SELECT doc_id, CASE WHEN octet_length(encode(text)) >= 100 THEN hex(encode(text)[101:150]) END AS bytes FROM documents")
def _(t):
    return t.documents.select("doc_id", F.hex(blob.read_range("text", F.lit(100), F.lit(50))).alias("bytes"))


@add("blob_append", "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS sha256, count(*) AS appends FROM conversations GROUP BY conv_id")
def _(t):
    grown = blob.append(t.conversations, ["conv_id"], ["turn"], "text")
    return grown.select("conv_id", blob.digest("content").alias("sha256"), "appends")


@add("blob_order", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY encode(text), doc_id) AS rank FROM documents")
def _(t):
    return blob.rank_by_content(t.documents, ["source"], "text", "doc_id").select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@add("blob_content_lookup", "SELECT d.doc_id AS probe, i.first AS doc_id, i.copies FROM documents d JOIN (SELECT text, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY text) i ON d.text = i.text")
def _(t):
    index = blob.content_index(t.documents, "doc_id", "text")
    probes = t.documents.select(F.col("doc_id").alias("probe"), "text")
    return blob.look_up_content(probes, index, "text").select("probe", "doc_id", "copies")


@add("blob_index", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    return blob.content_index(t.documents, "doc_id", "text")


@add("blob_dedup_report", "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id <> first")
def _(t):
    return blob.duplicates(t.documents, "doc_id", "text")


_PREFIX = "SELECT least(octet_length(encode(text)), 1024) AS n, encode(text)[1:1024] AS p, min(doc_id) AS first, arg_min(sha256(text), doc_id) AS d, count(*) - 1 AS rejected FROM documents GROUP BY 1, 2"


@add("prefix_index", f"SELECT n AS prefix_length, sha256(p) AS prefix, first AS doc_id, d AS sha256, rejected FROM ({_PREFIX})")
def _(t):
    index = blob.prefix_index(t.documents, "doc_id", "text")
    return index.select(F.col("prefix_length").cast("long").alias("prefix_length"), F.sha2("prefix", 256).alias("prefix"), "doc_id", "sha256", "rejected")


@add("prefix_rejections", f"SELECT sum(rejected) AS rejected, count(*) AS entries FROM ({_PREFIX})")
def _(t):
    return blob.prefix_index(t.documents, "doc_id", "text").agg(F.sum("rejected").alias("rejected"), F.count(F.lit(1)).alias("entries"))


@add("prefix_lookup", f"SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1024 OR sha256(text) = d THEN first END AS hit FROM documents JOIN ({_PREFIX}) i ON least(octet_length(encode(text)), 1024) = n AND encode(text)[1:1024] = p")
def _(t):
    index = blob.prefix_index(t.documents, "doc_id", "text")
    return blob.look_up_prefix(t.documents, index, "doc_id", "text")


@add("inrow_offrow", "SELECT CASE WHEN octet_length(encode(text)) > 1276 THEN 'offrow' ELSE 'inrow' END AS placement, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(t):
    size = F.octet_length(F.col("text").cast("binary")).cast("long")
    return t.documents.groupBy(blob.placement("text").alias("placement")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


_TIERS = "(SELECT tier, size_pages, cumulative_pages - size_pages AS low, cumulative_pages FROM (SELECT tier, size_pages, CAST(sum(size_pages) OVER (ORDER BY tier) AS BIGINT) AS cumulative_pages FROM (SELECT CAST(range AS BIGINT) AS tier, CAST(round((range // 8 + 1) ** (8 - range % 8) * (range // 8 + 2) ** (range % 8)) AS BIGINT) AS size_pages FROM range(24))))"


@add("extent_tiers", f"SELECT CAST(tier AS INTEGER) AS tier, size_pages, cumulative_pages FROM {_TIERS}")
def _(t):
    return blob.tier_table(t.spark, 24).select("tier", "size_pages", "cumulative_pages")


@add("extent_span", f"SELECT doc_id, p AS pages, tier + 1 AS extents FROM (SELECT doc_id, (octet_length(encode(text)) + 4095) // 4096 AS p FROM documents) JOIN {_TIERS} ON p > low AND p <= cumulative_pages")
def _(t):
    pages = scalar.pages_of(F.octet_length(F.col("text").cast("binary")).cast("long"))
    return t.documents.select("doc_id", pages.alias("pages")).withColumn("extents", blob.extent_count(F.col("pages")))


@add("tail_split", None)
def _(t):
    return t.documents.select("doc_id", F.col("n_chars").alias("pages"), blob.tail_split(F.col("n_chars")).alias("tiers"))


@add("page_compression", None)
def _(t):
    return t.pages.select("page_id", blob.compressed_size("html").alias("z")).select("page_id", "z.bytes", "z.stored")


@add("popularity_cdf", "SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS cumulative FROM documents")
def _(t):
    return running_total(t.documents.select("doc_id", "n_chars"), "doc_id", {"cumulative": "n_chars"}, cell=64).select("doc_id", "cumulative")


_CDF = "(SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS high, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS low, sum(n_chars) OVER () AS total FROM documents)"


@add("weighted_pick", f"SELECT event_id, doc_id FROM events JOIN {_CDF} ON (event_id * 7919) % CAST(total AS BIGINT) >= low AND (event_id * 7919) % CAST(total AS BIGINT) < high")
def _(t):
    bounds = running_total(t.documents.select("doc_id", "n_chars"), "doc_id", {"high": "n_chars"})
    bounds = bounds.select("doc_id", (F.col("high") - F.col("n_chars")).alias("low"), "high")
    total = t.documents.agg(F.sum("n_chars")).scalar()
    draw = F.pmod(F.col("event_id") * 7919, total)
    return joins.assign_interval(t.events.select("event_id"), draw, bounds, "low", "high").select("event_id", "doc_id")


@add("gen_name", "SELECT c_custkey, s[1 + (c_custkey // 100) % 10] || s[1 + (c_custkey // 10) % 10] || s[1 + c_custkey % 10] AS name FROM customer, (SELECT ['BAR', 'OUGHT', 'ABLE', 'PRI', 'PRES', 'ESE', 'ANTI', 'CALLY', 'ATION', 'EING'] AS s)")
def _(t):
    return t.customer.select("c_custkey", scalar.last_name(F.col("c_custkey")).alias("name"))


@add("district_selector", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_returnflag, l_linestatus, 'x', 'y'][1 + l_orderkey % 4] AS chosen FROM lineitem")
def _(t):
    place = (F.col("l_orderkey") % 4 + 1).cast("int")
    columns = [F.col("l_returnflag"), F.col("l_linestatus"), F.lit("x"), F.lit("y")]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.nth_column(place, columns).alias("chosen"))


@add("brand_flag", "SELECT p_partkey, CASE WHEN suffix(p_name, 'e') AND suffix(p_type, 'L') THEN 'B' ELSE 'G' END AS flag FROM part")
def _(t):
    both = F.when(F.endswith("p_name", F.lit("e")) & F.endswith("p_type", F.lit("L")), "B").otherwise("G")
    return t.part.select("p_partkey", both.alias("flag"))


@add("brand_mark", "SELECT p_partkey, CASE WHEN suffix(p_brand, '3') AND suffix(p_brand, '13') THEN 'B' ELSE 'G' END AS flag FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(scalar.brand_flag(F.col("p_brand"), mark="3") == "B", scalar.brand_flag(F.col("p_brand"), mark="13")).otherwise("G").alias("flag"))


@add("stock_replenish", "SELECT p_partkey, CASE WHEN p_size >= 5 + 10 THEN p_size - 5 ELSE p_size + 91 - 5 END AS left_over FROM part")
def _(t):
    return t.part.select("p_partkey", scalar.replenish(F.col("p_size"), F.lit(5)).alias("left_over"))


@add("audit_string", "SELECT o_orderkey, printf('| %4d %2d %4d %2d %4d $%7.2f %d%s%s %s', o_custkey, 1, 2, 3, 4, o_totalprice, o_orderkey, o_orderstatus, '    ', o_orderpriority)[1:500] AS note FROM orders")
def _(t):
    note = scalar.audit_entry(F.col("o_custkey"), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_orderstatus"), F.lit("    "), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", note.alias("note"))


@add("history_note", "SELECT n_nationkey, n_name || '    ' || r_name AS note FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", scalar.history_note(F.col("n_name"), F.col("r_name")).alias("note"))


@add("align_and_pack", "SELECT o_orderkey, (o_custkey + 63) // 64 * 64 AS up, o_custkey // 64 * 64 AS down, bit_count(o_custkey) = 1 AS power, (o_orderkey << 15) | (o_custkey & 32767) AS packed, o_orderkey AS offset_back, o_custkey & 32767 AS size_back FROM orders")
def _(t):
    packed = scalar.pack_location(F.col("o_orderkey"), F.col("o_custkey").bitwiseAND(F.lit(32767)))
    return t.orders.select(
        "o_orderkey", scalar.align_up(F.col("o_custkey"), 64).alias("up"), scalar.align_down(F.col("o_custkey"), 64).alias("down"),
        scalar.is_power_of_two(F.col("o_custkey")).alias("power"), packed.alias("packed"),
        scalar.unpack_offset(packed).alias("offset_back"), scalar.unpack_size(packed).alias("size_back"),
    )


@add("block_location", "SELECT event_id, event_id * 5000 // 65536 AS block, (event_id * 5000 % 65536) // 4096 AS page FROM events")
def _(t):
    offset = F.col("event_id") * 5000
    return t.events.select("event_id", scalar.block_of(offset, 65536).alias("block"), scalar.page_in_block(offset, 65536).alias("page"))


@add("key_order_fold", "SELECT c_custkey, rank() OVER (ORDER BY CAST(c_acctbal AS INTEGER)) AS place FROM customer")
def _(t):
    from pyspark.sql import Window as W

    whole = F.rint("c_acctbal").cast("int")
    return t.customer.select("c_custkey", F.rank().over(W.orderBy(scalar.fold_int(whole))).cast("long").alias("place"))


@add("checksums", "SELECT item_id, sha256(text) AS sha, hex(encode(text)[1:4]) AS head FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.hex(scalar.key_head(F.col("text"))).alias("head"))


@add("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", scalar.scalar_json(F.col("props"), "k").alias("k"))


@add("ratio_metrics", "SELECT user_id, count(*) FILTER (event_type = 'view') * 1.0 / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0) AS hit_ratio, round(1.0 / nullif(1 - count(*) FILTER (event_type = 'view') * 1.0 / count(*), 0) * 0.5, 6) AS amplification FROM events GROUP BY user_id")
def _(t):
    views, clicks = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    share = views / F.count(F.lit(1))
    moved = scalar.write_amplification(F.lit(False), F.lit(False), share, F.lit(0.5))
    return t.events.groupBy("user_id").agg(scalar.ratio(views, clicks).alias("hit_ratio"), F.round(moved, 6).alias("amplification"))
