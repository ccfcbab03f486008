"""Queries over the link joins, windows and streams, on the tables that are shaped like references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.operators import joins, windows
from docproof.registry import register
from docproof.sources import documents as sources
from docproof.sources import records
from docproof.sources.tables import load
from docproof.streaming import events as streams

EVENT_SPANS = "SELECT user_id AS doc, event_id AS id, epoch_us(ts) // 60000000 % 5000 AS s, event_type FROM events"


def event_spans(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), F.expr("unix_seconds(cast(ts as timestamp)) div 60 % 5000").alias("s"), "event_type")


@register("antecedent_asof", r"""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent_id FROM events""")
def antecedent_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events")
    return joins.asof_backward(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "antecedent_id").select("event_id", "antecedent_id")


@register("turn_antecedent", r"""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked_at FROM conversations""")
def turn_antecedent(spark: SparkSession, sf: str) -> DataFrame:
    return joins.asof_backward(load(spark, sf, "conversations"), "conv_id", ["turn"], F.col("role") == "user", F.col("turn"), "asked_at").select("conv_id", "turn", "asked_at")


@register("nearest_event_join", rf"""
WITH e AS ({EVENT_SPANS}), l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type = 'click'),
p AS (SELECT l.doc, l.id AS l_id, r.id AS r_id, CASE WHEN r.s >= l.s + 20 THEN r.s - l.s - 20 WHEN r.s + 10 <= l.s THEN l.s - r.s - 10 ELSE 0 END AS gap, r.s AS rs FROM l JOIN r USING (doc))
SELECT doc, l_id, r_id, gap FROM p WHERE gap <= 140 QUALIFY row_number() OVER (PARTITION BY doc, l_id ORDER BY gap, rs, r_id) = 1""")
def nearest_event_join(spark: SparkSession, sf: str) -> DataFrame:
    e = event_spans(spark, sf)
    left = e.where("event_type = 'error'").select("doc", F.col("id").alias("l_id"), F.col("s").alias("l_start"), (F.col("s") + 20).alias("l_end"))
    right = e.where("event_type = 'click'").select("doc", F.col("id").alias("r_id"), F.col("s").alias("r_start"), (F.col("s") + 10).alias("r_end"))
    return joins.nearest_interval(left, right, "doc", 140).select("doc", "l_id", "r_id", "gap")


@register("anti_overlap", rf"""
WITH e AS ({EVENT_SPANS}), l AS (SELECT * FROM e WHERE event_type = 'view'), r AS (SELECT * FROM e WHERE event_type = 'click')
SELECT doc, id AS l_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = l.doc AND l.s < r.s + 100 AND r.s < l.s + 50)""")
def anti_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = event_spans(spark, sf)
    left = e.where("event_type = 'view'").select("doc", F.col("id").alias("l_id"), F.col("s").alias("l_start"), (F.col("s") + 50).alias("l_end"))
    right = e.where("event_type = 'click'").select("doc", F.col("s").alias("r_start"), (F.col("s") + 100).alias("r_end"))
    return joins.anti_overlap(left, right, "doc").select("doc", "l_id")


@register("first_overlap", rf"""
WITH e AS ({EVENT_SPANS}), l AS (SELECT * FROM e WHERE event_type = 'signup'), r AS (SELECT * FROM e WHERE event_type = 'view')
SELECT l.doc, l.id AS g_id, min(r.id) AS r_id FROM l LEFT JOIN r ON r.doc = l.doc AND l.s < r.s + 300 AND r.s < l.s + 300 GROUP BY 1, 2""")
def first_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = event_spans(spark, sf)
    gold = e.where("event_type = 'signup'").select("doc", F.col("id").alias("g_id"), F.col("s").alias("l_start"), (F.col("s") + 300).alias("l_end"))
    found = e.where("event_type = 'view'").select("doc", F.col("id").alias("r_id"), F.col("s").alias("r_start"), (F.col("s") + 300).alias("r_end"))
    return joins.first_overlap(gold, found, "doc")


@register("adjacent_groups", r"""
WITH x AS (SELECT user_id, event_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 3600000000 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM x""")
def adjacent_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_id", "ts")
    near = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp")) <= 3_600_000_000
    return joins.adjacent_groups(rows, "user_id", ["ts", "event_id"], near, "island").select("user_id", "event_id", "island")


@register("interval_containment", r"""
WITH b AS (SELECT k AS band, k * 7 AS low, k * 7 + 10 AS high FROM (SELECT unnest(range(0, 8)) AS k))
SELECT p_partkey, band FROM part JOIN b ON p_size >= low AND p_size < high""")
def interval_containment(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.range(8).select(F.col("id").alias("band"), (F.col("id") * 7).alias("low"), (F.col("id") * 7 + 10).alias("high"))
    return joins.in_bands(load(spark, sf, "part").select("p_partkey", "p_size"), "p_size", bands, "low", "high", 10).select("p_partkey", "band")


@register("dictionary_semi", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def dictionary_semi(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").join(load(spark, sf, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@register("dictionary_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 250000)")
def dictionary_anti(spark: SparkSession, sf: str) -> DataFrame:
    large = load(spark, sf, "orders").where("o_orderstatus = 'P' and o_totalprice > 250000")
    return load(spark, sf, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("chain_walk", r"""
WITH RECURSIVE e AS (SELECT a.event_id AS node, b.event_id AS parent FROM events a LEFT JOIN events b ON b.event_id = a.event_id - 1 AND a.event_id % 40 <> 0),
w AS (SELECT node, node AS here, 0 AS hops FROM e UNION ALL SELECT w.node, e.parent, hops + 1 FROM w JOIN e ON e.node = w.here WHERE e.parent IS NOT NULL AND hops < 10)
SELECT node, max_by(here, hops) AS root, CAST(max(hops) AS INTEGER) AS hops FROM w GROUP BY node""")
def chain_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of up to 39 hops, of which 10 are followed."""
    e = load(spark, sf, "events").select("event_id")
    parents = e.select(F.col("event_id").alias("p"))
    rows = e.withColumn("p", F.when(F.col("event_id") % 40 != 0, F.col("event_id") - 1))
    rows = rows.join(parents.withColumn("there", F.lit(True)), "p", "left").select("event_id", F.when(F.col("there"), F.col("p")).alias("parent"))
    return joins.walk(rows, "event_id", "parent")


@register("fallback_join", r"""
SELECT p.p_partkey, coalesce(a.v, b.v) AS price, CASE WHEN a.v IS NOT NULL THEN 'returned' WHEN b.v IS NOT NULL THEN 'any' END AS found_in FROM part p
LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) a ON a.l_partkey = p.p_partkey
LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1) b ON b.l_partkey = p.p_partkey""")
def fallback_join(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem")
    first = items.where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_partkey").alias("k1")).agg(F.max("l_extendedprice").alias("price"))
    second = items.groupBy(F.col("l_partkey").alias("k2")).agg(F.max("l_extendedprice").alias("price"))
    out = joins.first_found(load(spark, sf, "part").select("p_partkey"), [(first, F.col("p_partkey") == F.col("k1"), "returned"), (second, F.col("p_partkey") == F.col("k2"), "any")], "price")
    return out.select("p_partkey", "price", "found_in")


@register("archive_lookup", r"""
SELECT DISTINCT l.l_suppkey AS citation, CASE WHEN s.s_suppkey IS NULL THEN -1 ELSE 200 END AS status FROM lineitem l LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = l.l_suppkey""")
def archive_lookup(spark: SparkSession, sf: str) -> DataFrame:
    archive = load(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("citation"), F.lit(200).alias("status"))
    return records.lookup(load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("citation")), archive).select("citation", "status")


@register("document_order", r"""
SELECT user_id, event_id, 'cite_' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS VARCHAR), 4, '0') AS citation_id FROM events""")
def document_order(spark: SparkSession, sf: str) -> DataFrame:
    return windows.numbered(load(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "citation_id")


@register("left_clamp", "SELECT event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clamp FROM events")
def left_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", windows.running_max_before("event_id", "user_id", ["ts", "event_id"]).alias("clamp"))


@register("forward_run", r"""
SELECT user_id, event_id FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS top FROM events) WHERE value >= top""")
def forward_run(spark: SparkSession, sf: str) -> DataFrame:
    return windows.forward_run(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id")


@register("rate_window", r"""
SELECT event_id, count(*) OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").withColumn("k", F.col("user_id") % 10)
    return windows.rate_window(rows, "k", "ts", F.lit(1), 3600).select("event_id", "in_window")


@register("cache_ttl", r"""
SELECT event_id, (event_id % 3 <> 0) AND date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') > 604800 AS expired FROM events""")
def cache_ttl(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, 200).otherwise(404)
    return load(spark, sf, "events").select("event_id", windows.expired(status, F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("expired"))


@register("page_map", r"""
SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS page, CAST(sum(length(text) + 1) OVER w - length(text) - 1 AS BIGINT) AS s, CAST(sum(length(text) + 1) OVER w - 1 AS BIGINT) AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def page_map(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return sources.page_map(pages).select("doc_id", F.explode("page_map").alias("m")).select("doc_id", "m.page", "m.s", "m.e")


@register("offset_page", r"""
WITH m AS (SELECT conv_id, turn, sum(length(text) + 1) OVER w - length(text) - 1 AS s, sum(length(text) + 1) OVER w - 1 AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT c.conv_id AS doc_id, (SELECT min(turn) FROM m WHERE m.conv_id = c.conv_id AND m.s <= 50 AND 50 < m.e) AS page FROM (SELECT DISTINCT conv_id FROM conversations) c""")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return sources.page_map(pages).select("doc_id", sources.page_of("page_map", "50").alias("page"))


@register("tumbling", r"""
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling(load(spark, sf, "events"))


@register("sliding", r"""
SELECT window_start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start FROM events) GROUP BY 1""")
def sliding(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sliding(load(spark, sf, "events"))


@register("session", r"""
WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM y GROUP BY user_id, g""")
def session(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(load(spark, sf, "events"))


@register("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@register("request_replies", r"""
SELECT event_id, CASE event_type WHEN 'error' THEN '{"jsonrpc":"2.0","error":{"code":-32700,"message":"parse error"}}' WHEN 'signup' THEN '{"jsonrpc":"2.0","id":"' || event_id || '","error":{"code":-32601,"message":"unknown method"}}'
  WHEN 'view' THEN '{"jsonrpc":"2.0","id":"' || event_id || '","result":{"method":"tools/call","n_chars":' || length(props) || '}}' ELSE '{"jsonrpc":"2.0","id":"' || event_id || '","result":{"method":"tools/list"}}' END AS value FROM events WHERE event_type <> 'click'""")
def request_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Every reply as sent; a click stands for a notification, which has none."""
    line = F.expr("""CASE event_type WHEN 'click' THEN '{"jsonrpc": "2.0", "method": "ping"}' WHEN 'error' THEN concat('not json ', event_id) WHEN 'signup' THEN concat('{"jsonrpc": "2.0", "id": "', event_id, '", "method": "guess"}')
      WHEN 'view' THEN concat('{"jsonrpc": "2.0", "id": "', event_id, '", "method": "tools/call", "params": {"name": "verify", "arguments": {"text": "', repeat('x', length(props)), '"}}}')
      ELSE concat('{"jsonrpc": "2.0", "id": "', event_id, '", "method": "tools/list"}') END""")
    return streams.responses(load(spark, sf, "events").select("event_id", line.alias("value")), "event_id").select("event_id", "value")
