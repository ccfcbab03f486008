"""Queries over verdicts, aggregates, metrics and reports. Checks and entries are derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.operators import aggregates as agg
from docproof.operators import verdicts as V
from docproof.registry import register
from docproof.sources import records, sinks
from docproof.sources.tables import load

#: One check for each order line: line number gives the dimension, part key the verdict, supplier key the confidence.
CHECKS_SQL = """
checks AS (SELECT l_orderkey, l_linenumber, ['existence', 'case_name', 'quote', 'pincite', 'reporter_valid', 'court', 'year'][(l_linenumber - 1) % 7 + 1] AS dimension,
  ['PASS', 'PASS', 'PASS', 'N/A', 'NOT_CHECKABLE', 'FAIL', 'NOT_FOUND', 'PENDING', 'PASS', 'AMBIGUOUS', 'OUT_OF_SCOPE', 'PASS'][l_partkey % 12 + 1] AS verdict,
  CASE l_suppkey % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' END AS confidence FROM lineitem)"""
OVERALL_SQL = CHECKS_SQL + """,
entries AS (SELECT l_orderkey, CASE WHEN bool_and(verdict = 'PENDING') THEN 'PENDING' WHEN bool_or(verdict = 'FAIL') THEN 'FLAGGED'
  WHEN bool_or(dimension = 'existence' AND verdict IN ('NOT_FOUND', 'OUT_OF_SCOPE')) THEN 'UNVERIFIED'
  WHEN bool_or(verdict IN ('NOT_CHECKABLE', 'AMBIGUOUS', 'PENDING')) OR bool_or(coalesce(confidence IN ('medium', 'low'), false)) THEN 'REVIEW'
  WHEN bool_and(verdict IN ('PASS', 'N/A')) AND bool_or(verdict = 'PASS') THEN 'VERIFIED' ELSE 'REVIEW' END AS overall FROM checks GROUP BY 1)"""


def checks(spark: SparkSession, sf: str) -> DataFrame:
    dimension = F.expr("array('existence', 'case_name', 'quote', 'pincite', 'reporter_valid', 'court', 'year')[(l_linenumber - 1) % 7]")
    verdict = F.expr("array('PASS', 'PASS', 'PASS', 'N/A', 'NOT_CHECKABLE', 'FAIL', 'NOT_FOUND', 'PENDING', 'PASS', 'AMBIGUOUS', 'OUT_OF_SCOPE', 'PASS')[cast(l_partkey % 12 as int)]")
    confidence = F.expr("CASE l_suppkey % 5 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' END")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", dimension.alias("dimension"), verdict.alias("verdict"), confidence.alias("confidence"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return V.rollup(checks(spark, sf), ["l_orderkey"])


@register("verdict_rollup", f"WITH {OVERALL_SQL} SELECT l_orderkey, overall FROM entries")
def verdict_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf)


@register("overall_counts", f"WITH {OVERALL_SQL} SELECT o.overall, count(e.overall) AS n FROM (VALUES ('FLAGGED'), ('UNVERIFIED'), ('REVIEW'), ('PENDING'), ('VERIFIED')) o(overall) LEFT JOIN entries e USING (overall) GROUP BY 1")
def overall_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.counts_filled(entries(spark, sf))


@register("verdict_fold", f"""
WITH RECURSIVE {CHECKS_SQL}, p AS (SELECT l_orderkey, verdict, CASE WHEN l_linenumber = 3 AND l_orderkey % 4 = 0 THEN 'existence' END AS suppressed_by,
  CASE verdict WHEN 'PASS' THEN 5 WHEN 'N/A' THEN 4 WHEN 'NOT_FOUND' THEN 2 WHEN 'FAIL' THEN 1 WHEN 'PENDING' THEN 0 ELSE 3 END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, verdict) AS k, count(*) OVER (PARTITION BY l_orderkey) AS m FROM checks),
f AS (SELECT l_orderkey, k, m, verdict, suppressed_by, s FROM p WHERE k = 1 UNION ALL
  SELECT p.l_orderkey, p.k, p.m, CASE WHEN t THEN p.verdict ELSE f.verdict END, CASE WHEN t THEN p.suppressed_by ELSE f.suppressed_by END, CASE WHEN t THEN p.s ELSE f.s END
  FROM f JOIN p ON p.l_orderkey = f.l_orderkey AND p.k = f.k + 1, LATERAL (SELECT f.verdict = 'PENDING' OR (f.suppressed_by IS NULL AND NOT (f.verdict = 'FAIL' AND p.verdict <> 'FAIL') AND p.s <= f.s) AS t) AS q)
SELECT l_orderkey, verdict, suppressed_by, CAST(m AS INTEGER) AS n_proposals FROM f WHERE k = m""")
def verdict_fold(spark: SparkSession, sf: str) -> DataFrame:
    suppressed = F.when((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 4 == 0), "existence")
    proposals = checks(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("stage_ord"), F.lit(0).alias("seq"), "verdict", suppressed.alias("suppressed_by"))
    return V.fold(proposals, ["l_orderkey"]).select("l_orderkey", "verdict", "suppressed_by", "n_proposals")


@register("status_firewall", """
WITH l AS (SELECT o_orderkey, [200, 200, 300, 400, 404, 429, 200, 300, 400, -1][o_orderkey % 10 + 1] AS status, o_custkey % 3 AS n_matching, o_custkey % 2 = 0 AS name_asserted, CASE WHEN o_custkey % 5 = 0 THEN 'PASS' ELSE 'FAIL' END AS local_reporter FROM orders),
r AS (SELECT o_orderkey, unnest(CASE WHEN status = 200 OR (status = 300 AND n_matching = 1) THEN ['existence:PASS:']
  WHEN status = 300 AND n_matching = 0 AND name_asserted THEN ['existence:AMBIGUOUS:', 'case_name:FAIL:']
  WHEN status = 300 THEN ['existence:AMBIGUOUS:', 'case_name:NOT_CHECKABLE:existence', 'court:NOT_CHECKABLE:existence', 'year:NOT_CHECKABLE:existence', 'precedential:NOT_CHECKABLE:existence']
  WHEN status = -1 THEN ['existence:NOT_CHECKABLE:']
  WHEN status = 400 THEN ['existence:NOT_CHECKABLE:reporter_valid', CASE WHEN local_reporter = 'PASS' THEN 'reporter_valid:NOT_CHECKABLE:' ELSE 'reporter_valid:FAIL:' END]
  ELSE ['existence:NOT_FOUND:'] END) AS c FROM l)
SELECT o_orderkey, split_part(c, ':', 1) AS dimension, split_part(c, ':', 2) AS verdict, nullif(split_part(c, ':', 3), '') AS suppressed_by FROM r""")
def status_firewall(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").selectExpr("o_orderkey", "array(200, 200, 300, 400, 404, 429, 200, 300, 400, -1)[cast(o_orderkey % 10 as int)] AS status", "o_custkey % 3 AS n_matching", "o_custkey % 2 = 0 AS name_asserted", "if(o_custkey % 5 = 0, 'PASS', 'FAIL') AS local_reporter")
    return V.firewall(rows).select("o_orderkey", "dimension", "verdict", "suppressed_by")


@register("lookup_routing", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 2) THEN 'INHERIT' WHEN o_custkey % 7 = 0 THEN 'SET' WHEN o_orderkey % 6 = 3 OR o_custkey % 5 = 0 THEN 'OUT_OF_SCOPE' WHEN o_custkey % 4 = 0 THEN 'SUPPRESSED' WHEN o_custkey % 3 = 0 THEN 'NO_KEY' ELSE 'LOOK_UP' END AS route FROM orders""")
def lookup_routing(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("array('full_case', 'short_case', 'id', 'law', 'full_case', 'full_case')[cast(o_orderkey % 6 as int)]")
    vendor = V.vendor_only(F.expr("if(o_custkey % 5 = 0, 'U.S. LEXIS', 'F.2d')"))
    route = V.routing(kind, F.when(F.col("o_custkey") % 7 == 0, "PASS"), F.lit(False), vendor, F.when(F.col("o_custkey") % 4 == 0, "FAIL").otherwise("PASS"), F.when(F.col("o_custkey") % 3 != 0, F.lit("key")))
    return load(spark, sf, "orders").select("o_orderkey", route.alias("route"))


@register("check_constraints", f"""
WITH {CHECKS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN verdict = 'FAIL' THEN 'evidence' WHEN verdict = 'NOT_FOUND' THEN 'sources' ELSE 'reason' END AS broken FROM checks
WHERE (verdict = 'FAIL' AND l_orderkey % 2 = 0) OR (verdict = 'NOT_FOUND' AND l_orderkey % 3 = 0) OR (verdict IN ('NOT_CHECKABLE', 'OUT_OF_SCOPE') AND l_orderkey % 5 = 0)""")
def check_constraints(spark: SparkSession, sf: str) -> DataFrame:
    rows = checks(spark, sf).withColumns({"evidence": F.expr("if(l_orderkey % 2 = 0, ' ', 'seen')"), "sources": F.expr("if(l_orderkey % 3 = 0, array(), array('a'))"), "reason": F.expr("if(l_orderkey % 5 = 0, null, 'r')")})
    return V.violations(rows).select("l_orderkey", "l_linenumber", "broken")


ENTRY_KINDS = "array('full_case', 'full_case', 'law', 'journal', 'short_case')[cast(o_orderkey % 5 as int)]"


@register("coverage_measure", """
WITH e AS (SELECT o_custkey, ['full_case', 'full_case', 'law', 'journal', 'short_case'][o_orderkey % 5 + 1] AS kind, ['PASS', 'FAIL', 'NOT_FOUND', 'AMBIGUOUS', 'PENDING'][(o_orderkey // 5) % 5 + 1] AS existence FROM orders),
b AS (SELECT o_custkey, CASE WHEN kind = 'law' THEN 'statutory' WHEN kind = 'journal' THEN 'not_consulted' WHEN existence IN ('PASS', 'FAIL') THEN 'reachable' WHEN existence = 'NOT_FOUND' THEN 'absent' WHEN existence = 'AMBIGUOUS' THEN 'indeterminate' ELSE 'not_consulted' END AS b FROM e),
c AS (SELECT o_custkey, count(*) AS citations, count_if(b = 'reachable') AS reachable, count_if(b = 'absent') AS absent, count_if(b = 'indeterminate') AS indeterminate, count_if(b = 'not_consulted') AS not_consulted, count_if(b = 'statutory') AS statutory FROM b GROUP BY 1)
SELECT o_custkey, citations, CAST(reachable AS BIGINT) AS reachable, CAST(absent AS BIGINT) AS absent, CAST(indeterminate AS BIGINT) AS indeterminate, CAST(not_consulted AS BIGINT) AS not_consulted, CAST(statutory AS BIGINT) AS statutory,
  round(CAST(reachable AS DOUBLE) / nullif(CAST(reachable + absent + indeterminate AS DOUBLE), 0), 6) AS rate, coalesce(CAST(absent AS DOUBLE) / nullif(CAST(reachable + absent + indeterminate AS DOUBLE), 0) >= 0.15, false) AS headline FROM c""")
def coverage_measure(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_custkey", F.expr(ENTRY_KINDS).alias("kind"), F.expr("array('PASS', 'FAIL', 'NOT_FOUND', 'AMBIGUOUS', 'PENDING')[cast(o_orderkey div 5 % 5 as int)]").alias("existence"))
    return V.coverage(rows, ["o_custkey"])


@register("severity_topk", f"""
WITH {OVERALL_SQL} SELECT o_custkey, o_orderkey, overall FROM entries JOIN orders ON o_orderkey = l_orderkey
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE overall WHEN 'FLAGGED' THEN 0 WHEN 'UNVERIFIED' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'PENDING' THEN 3 ELSE 4 END, o_orderkey) <= 3""")
def severity_topk(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = entries(spark, sf).join(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(V.ordinal(F.col("overall"), V.OVERALLS), "o_orderkey"))
    return rows.withColumn("r", rank).where("r <= 3").select("o_custkey", "o_orderkey", "overall")


@register("blocking_check", f"""
WITH {CHECKS_SQL} SELECT l_orderkey, CASE WHEN bool_or(dimension = 'reporter_valid') THEN 'reporter_valid' ELSE 'existence' END AS blocked_by FROM checks
WHERE dimension IN ('reporter_valid', 'existence') AND verdict NOT IN ('PASS', 'N/A', 'PENDING') GROUP BY 1""")
def blocking_check(spark: SparkSession, sf: str) -> DataFrame:
    return V.blocking(checks(spark, sf), ["l_orderkey"])


@register("inherit_parent", """
WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id - 1 END AS antecedent_id, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS existence FROM events)
SELECT e.id, CASE WHEN e.antecedent_id IS NULL THEN e.existence ELSE coalesce(h.existence, 'NOT_CHECKABLE') END AS existence FROM e LEFT JOIN e h ON h.id = e.id - e.id % 4""")
def inherit_parent(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("if(event_id % 4 = 0, null, event_id - 1)").alias("antecedent_id"), F.expr("if(event_type = 'error', 'FAIL', 'PASS')").alias("existence"))
    return V.inherit(rows).select("id", "existence")


@register("metadata_checks", """
SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'NOT_CHECKABLE' WHEN o_custkey % 4 = 0 THEN 'PASS' WHEN o_custkey % 4 = 1 THEN 'NOT_CHECKABLE' ELSE 'FAIL' END AS year_verdict,
  CASE WHEN (o_custkey % 100) / 100.0 >= 0.60 THEN 'PASS' WHEN o_orderkey % 3 < 2 THEN 'NOT_CHECKABLE' WHEN (o_custkey % 100) / 100.0 >= 0.34 THEN 'NOT_CHECKABLE' ELSE 'FAIL' END AS name_verdict FROM orders""")
def metadata_checks(spark: SparkSession, sf: str) -> DataFrame:
    filed = F.date_format("o_orderdate", "yyyy-MM-dd")
    asserted = F.expr("if(o_custkey % 10 = 0, 'n.d.', cast(year(o_orderdate) + o_custkey % 4 as string))")
    return load(spark, sf, "orders").select("o_orderkey", V.year_verdict(asserted, filed).alias("year_verdict"), V.name_verdict((F.col("o_custkey") % 100) / 100, F.col("o_orderkey") % 3).alias("name_verdict"))


@register("quote_checks", """
WITH f AS (SELECT l_orderkey, l_quantity > 12 AS found, l_discount * 10 AS similarity, l_linenumber % 2 = 0 AS substitution, l_orderkey % 9 AS n_opinions, l_linenumber <> 1 AS long FROM lineitem)
SELECT l_orderkey, CASE WHEN count_if(long) = 0 THEN 'N/A' WHEN max(n_opinions) FILTER (long) = 0 THEN 'NOT_CHECKABLE' WHEN bool_or(NOT found AND similarity >= 0.75 AND substitution) FILTER (long) THEN 'FAIL'
  WHEN bool_or(NOT found AND similarity < 0.60) FILTER (long) THEN 'NOT_CHECKABLE' WHEN NOT bool_and(found) FILTER (long) THEN 'NOT_CHECKABLE' ELSE 'PASS' END AS verdict FROM f GROUP BY 1""")
def quote_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey", "if(l_linenumber <> 1, repeat('x', 30), 'short') AS quote", "l_quantity > 12 AS found", "l_discount * 10 AS similarity", "l_linenumber % 2 = 0 AS substitution", "l_orderkey % 9 AS n_opinions")
    return V.quote_verdicts(rows, ["l_orderkey"])


@register("quote_source_checks", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN event_type IN ('error', 'click') THEN CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'NOT_CHECKABLE' END WHEN event_id % 3 = 0 THEN 'NOT_CHECKABLE' ELSE 'PASS' END AS verdict FROM events""")
def quote_source_checks(spark: SparkSession, sf: str) -> DataFrame:
    only = F.expr("CASE event_type WHEN 'error' THEN 'syllabus' WHEN 'click' THEN 'separate' WHEN 'signup' THEN 'plurality' END")
    return load(spark, sf, "events").select("event_id", V.quote_source(F.col("event_id") % 7 != 0, only, F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("verdict"))


@register("pincite_checks", """
WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE 100 + o_orderkey % 40 END AS pin, CASE WHEN o_custkey % 3 = 0 THEN 110 + o_custkey % 20 END AS located, o_orderkey % 4 AS marks FROM orders)
SELECT o_orderkey, CASE WHEN pin IS NULL THEN 'N/A' WHEN marks = 0 THEN 'NOT_CHECKABLE' WHEN located IS NOT NULL AND abs(located - pin) <= 1 THEN 'PASS' WHEN located IS NOT NULL OR marks < 2 THEN 'NOT_CHECKABLE' WHEN pin BETWEEN 105 AND 125 THEN 'NOT_CHECKABLE' ELSE 'FAIL' END AS verdict FROM p""")
def pincite_checks(spark: SparkSession, sf: str) -> DataFrame:
    pin, located = F.expr("if(o_custkey % 8 = 0, null, 100 + o_orderkey % 40)"), F.expr("if(o_custkey % 3 = 0, 110 + o_custkey % 20, null)")
    return load(spark, sf, "orders").select("o_orderkey", V.pincite_verdict(pin, located, F.lit(105), F.lit(125), F.col("o_orderkey") % 4).alias("verdict"))


@register("doc_calibration", """
WITH r AS (SELECT l_orderkey, l_linenumber, 1 - l_discount / 4 AS ratio FROM lineitem), b AS (SELECT l_orderkey, median(ratio) AS m, count(*) AS n FROM r GROUP BY 1)
SELECT r.l_orderkey, l_linenumber, round(m, 6) AS baseline, n AS n_ratios, (n >= 4 AND round(m, 6) >= 0.98 AND ratio < round(m, 6) - 0.004) AS outlier FROM r JOIN b USING (l_orderkey)""")
def doc_calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (1 - F.col("l_discount") / 4).alias("ratio"))
    return agg.calibration(rows, "l_orderkey", "ratio", 4, 0.98, 0.004).select("l_orderkey", "l_linenumber", "baseline", "n_ratios", "outlier")


@register("precision_recall", """
WITH x AS (SELECT lang, toxic = 1 AS g, quality = 0 AS f FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, CAST(count_if(g AND f) AS BIGINT) AS tp, CAST(count_if(NOT g AND f) AS BIGINT) AS fp, CAST(count_if(g AND NOT f) AS BIGINT) AS fn FROM x GROUP BY ROLLUP (lang)),
d AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r FROM c)
SELECT lang, is_total, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM d""")
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return agg.precision_recall(rows, F.col("toxic") == 1, F.col("quality") == 0, "lang")


@register("threshold_sweep", """
WITH x AS (SELECT n_chars, quality = 1 AS g FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest([100.0, 300.0, 1000.0, 3000.0, 10000.0])::DOUBLE AS threshold),
c AS (SELECT threshold, count_if(g AND n_chars >= threshold) AS tp, count_if(NOT g AND n_chars >= threshold) AS fp, count_if(g) AS gold, count_if(NOT g) AS clean FROM t CROSS JOIN x GROUP BY 1)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(CAST(tp AS DOUBLE) / nullif(gold, 0), 6) AS recall, round(CAST(fp AS DOUBLE) / nullif(clean, 0), 6) AS fpr, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision FROM c""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", "n_chars").join(load(spark, sf, "labels"), "doc_id")
    return agg.sweep(rows, "n_chars", F.col("quality") == 1, [100, 300, 1000, 3000, 10000])


@register("grid_outliers", """
WITH b AS (SELECT value, event_type = 'error' AS g, median(value) OVER (PARTITION BY user_id) AS m FROM events), t AS (SELECT unnest([0.0, 10.0, 25.0])::DOUBLE AS margin)
SELECT margin, CAST(count_if(value < m - margin) AS BIGINT) AS flagged, CAST(count_if(value < m - margin AND g) AS BIGINT) AS hits FROM t CROSS JOIN b GROUP BY 1""")
def grid_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return agg.outlier_grid(load(spark, sf, "events"), "user_id", "value", F.col("event_type") == "error", [0, 10, 25])


@register("batch_summary", f"""
WITH {OVERALL_SQL} SELECT o_custkey, count(*) AS citations, CAST(count_if(overall = 'FLAGGED') AS BIGINT) AS flagged, CAST(count_if(overall = 'UNVERIFIED') AS BIGINT) AS unverified, CAST(count_if(overall = 'REVIEW') AS BIGINT) AS review, CAST(count_if(overall = 'VERIFIED') AS BIGINT) AS verified
FROM entries JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = entries(spark, sf).join(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return agg.batch_summary(rows, "o_custkey")


@register("reader_stats", """
SELECT event_type, count(*) AS calls, CAST(count_if(value > 90) AS BIGINT) AS failures, CAST(sum(length(props)) AS BIGINT) AS chars, round(sum(value), 4) AS seconds, round(avg(value), 4) AS mean_seconds, max(value) AS max_seconds FROM events GROUP BY 1""")
def reader_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("event_type", (F.col("value") > 90).alias("failed"), F.length("props").alias("chars"), F.col("value").alias("seconds"))
    out = agg.reader_stats(rows, ["event_type"])
    return out.withColumns({"seconds": F.round("seconds", 4), "mean_seconds": F.round("mean_seconds", 4)})


@register("common_verdicts", f"WITH {CHECKS_SQL} SELECT verdict, count(*) AS n FROM checks GROUP BY 1 ORDER BY n DESC, verdict LIMIT 12")
def common_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return checks(spark, sf).groupBy("verdict").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict").limit(12)


@register("checks_cell", f"""
WITH {CHECKS_SQL} SELECT l_orderkey, coalesce(string_agg(dimension || ': `' || verdict || '`', '; ' ORDER BY list_position(['FAIL', 'NOT_FOUND', 'AMBIGUOUS', 'NOT_CHECKABLE', 'OUT_OF_SCOPE', 'N/A', 'PASS'], verdict),
  list_position(['reporter_valid', 'existence', 'case_name', 'court', 'year', 'quote', 'pincite'], dimension)) FILTER (verdict <> 'PENDING'), 'none decided') AS checks FROM checks GROUP BY 1""")
def checks_cell(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.checks_cell(checks(spark, sf), ["l_orderkey"])


@register("report_lines")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    cust = load(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    return sinks.report_lines(entries(spark, sf).join(cust, "l_orderkey"), checks(spark, sf).join(cust, "l_orderkey"), "o_custkey", "l_orderkey")


@register("ledger_json")
def ledger_json(spark: SparkSession, sf: str) -> DataFrame:
    cust = load(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    return sinks.ledger_json(entries(spark, sf).join(cust, "l_orderkey"), checks(spark, sf).join(cust, "l_orderkey"), "o_custkey", "l_orderkey")


@register("annotations", f"WITH {OVERALL_SQL} SELECT l_orderkey, CASE overall WHEN 'FLAGGED' THEN 'problem' WHEN 'UNVERIFIED' THEN 'not_found' ELSE 'needs_review' END AS state FROM entries WHERE overall IN ('FLAGGED', 'UNVERIFIED', 'REVIEW')")
def annotations(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.annotations(entries(spark, sf)).select("l_orderkey", "state")


@register("register_items", """
SELECT o_orderkey, 'Fabricated' AS type, 'Case Law' AS category, CAST(o_custkey AS VARCHAR) || ' F.3d ' || CAST(o_orderkey % 900 AS VARCHAR) AS narrative FROM orders
UNION ALL SELECT o_orderkey, 'Misrepresented', 'Statute', 'x' FROM orders""")
def register_items(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat('Fabricated: Case Law | ', o_custkey, ' F.3d ', o_orderkey % 900, ' || Misrepresented: Statute | x ||')")
    return records.items(load(spark, sf, "orders").select("o_orderkey", raw.alias("items")), "items").select("o_orderkey", "type", "category", "narrative")


@register("rel_revenue_rollup", """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INTEGER) AS level, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)""")
def rel_revenue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    level = (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int")
    return rows.cube("l_returnflag", "l_linestatus").agg(level.alias("level"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("rel_top_orders", """
SELECT n_name, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def rel_top_orders(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rank = F.row_number().over(W.partitionBy("n_name").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.withColumn("r", rank).where("r <= 2").select("n_name", "o_orderkey", "o_totalprice")


@register("rel_set_ops", """
(SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0) INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10""")
def rel_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer")
    left = load(spark, sf, "orders").select(F.col("o_custkey").alias("k")).subtract(customers.where("c_acctbal < 0").select("c_custkey"))
    return left.intersect(customers.where("c_nationkey < 10").select("c_custkey"))


@register("rel_full_outer", """
SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def rel_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").select("k", "customers", "suppliers")
