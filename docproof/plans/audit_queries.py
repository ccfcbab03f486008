"""Queries over whole audits, archives, reporters, ledgers, evaluations and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.functions import reporters, text
from docproof.operators import archive, joins, ledger
from docproof.operators import verdicts as V
from docproof.plans import audit as plan
from docproof.plans.link_queries import EVENT_SPANS, event_spans
from docproof.plans.text_queries import WORDS
from docproof.plans.verdict_queries import CHECKS_SQL, OVERALL_SQL, checks, entries
from docproof.registry import register
from docproof.sources import sinks
from docproof.sources.tables import load
from docproof.streaming import budgets


def party(key: str) -> str:
    """A party's name from a key: eight letters that no two keys are likely to share."""
    return f"translate(substr(md5(cast({key} as string)), 1, 8), '0123456789', 'ghijklmnop')"


def titled(key: str) -> str:
    return f"concat(upper(left({party(key)}, 1)), substr({party(key)}, 2))"


WRONG = "l_linenumber % 3 = 0 AND l_quantity > 25"


def briefs(spark: SparkSession, sf: str) -> DataFrame:
    """One document for each order: a sentence for each line, which cites the case of its part and quotes a passage."""
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "benchmark").withColumnRenamed("text", "passage"), F.expr("l_partkey % 40 = item_id"))
    sentence = f"""concat('As was held there, "', if(l_tax >= 0.07, concat(substr(passage, 21, 30), ' zzzzz ', substr(passage, 51, 30)), substr(passage, 21, 60)), '" ',
      if({WRONG}, concat({titled("l_partkey + 5000011")}, ' v. ', {titled("l_partkey + 6000011")}), concat({titled("l_partkey")}, ' v. ', {titled("l_partkey + 1000003")})),
      ', ', l_partkey div 50000 + 1, ' F.2d ', l_partkey % 50000 + 1, if(l_returnflag = 'A', concat('; 999 F.2d ', l_partkey % 50000 + 1), ''),
      ' (', 1950 + l_partkey % 60 + CASE l_linenumber % 4 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END, '). ')"""
    rest = F.repeat(F.lit("Nothing else is of note here. "), F.lit(7))  # ends every sentence; added when they have met
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(sentence).alias("s"))))
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["s"], rest)), "").alias("text"))


def cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Clusters (none for some parts, two for others) and the opinions' texts."""
    p = load(spark, sf, "part").where("p_size % 10 <> 0").withColumn("normalized", F.expr("concat(p_partkey div 50000 + 1, ' F.2d ', p_partkey % 50000 + 1)"))
    own = p.select("normalized", F.expr("p_partkey * 2").alias("cluster_id"), F.expr(f"concat({titled('p_partkey')}, ' v. ', {titled('p_partkey + 1000003')})").alias("case_name"), F.expr("concat(1950 + p_partkey % 60, '-05-01')").alias("filed"))
    other = p.where("p_size % 10 = 1").select("normalized", F.expr("p_partkey * 2 + 1").alias("cluster_id"), F.expr(f"concat({titled('p_partkey + 2000003')}, ' v. ', {titled('p_partkey + 3000003')})").alias("case_name"), F.expr("concat(1970 + p_partkey % 60, '-05-01')").alias("filed"))
    opinions = p.join(load(spark, sf, "benchmark"), F.expr("p_partkey % 40 = item_id")).select(F.expr("p_partkey * 2").alias("cluster_id"), F.lit("lead").alias("version"), "text")
    return own.union(other), opinions


AUDIT_SQL = """
WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_partkey AS k, l_linenumber % 3 = 0 AND l_quantity > 25 AS wrong,
    CASE l_linenumber % 4 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END AS delta, l_returnflag = 'A' AS contested, l_tax >= 0.07 AS altered, p_size % 10 AS z FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT *, sum(1 + CAST(contested AS INT)) OVER (PARTITION BY doc_id ORDER BY i) - 1 - CAST(contested AS INT) AS place FROM l),
m AS (SELECT *, CASE WHEN z = 0 THEN 'NOT_FOUND' WHEN z = 1 AND (wrong OR (NOT contested AND delta > 1)) THEN 'AMBIGUOUS' ELSE 'PASS' END AS existence FROM n),
e AS (SELECT doc_id, place, (k // 50000 + 1) || ' F.2d ' || (k % 50000 + 1) AS normalized, existence,
    CASE WHEN existence = 'AMBIGUOUS' OR (existence = 'PASS' AND wrong) THEN 'FAIL' WHEN existence = 'PASS' THEN 'PASS' ELSE 'NOT_CHECKABLE' END AS case_name,
    CASE WHEN existence <> 'PASS' OR contested OR delta = 1 THEN 'NOT_CHECKABLE' WHEN delta = 0 THEN 'PASS' ELSE 'FAIL' END AS year,
    CASE WHEN contested THEN 'N/A' WHEN existence <> 'PASS' THEN 'NOT_CHECKABLE' WHEN altered THEN 'FAIL' ELSE 'PASS' END AS quote FROM m
  UNION ALL SELECT doc_id, place + 1, '999 F.2d ' || (k % 50000 + 1), 'NOT_FOUND', 'NOT_CHECKABLE', 'NOT_CHECKABLE', 'N/A' FROM m WHERE contested),
c AS (SELECT doc_id, place, unnest([{'o': 0, 'd': 'existence', 'v': existence}, {'o': 1, 'd': 'case_name', 'v': case_name}, {'o': 2, 'd': 'year', 'v': year}, {'o': 3, 'd': 'quote', 'v': quote}]) AS c FROM e),
cells AS (SELECT doc_id, place, string_agg(c.d || ': `' || c.v || '`', '; ' ORDER BY list_position(['FAIL', 'NOT_FOUND', 'AMBIGUOUS', 'NOT_CHECKABLE', 'OUT_OF_SCOPE', 'N/A', 'PASS'], c.v), c.o) AS checks FROM c GROUP BY 1, 2),
a AS (SELECT doc_id, 'cite_' || lpad(CAST(place AS VARCHAR), 4, '0') AS citation_id, normalized,
  CASE WHEN 'FAIL' IN (case_name, year, quote) THEN 'FLAGGED' WHEN existence = 'NOT_FOUND' THEN 'UNVERIFIED' WHEN existence = 'AMBIGUOUS' OR 'NOT_CHECKABLE' IN (case_name, year, quote) THEN 'REVIEW' ELSE 'VERIFIED' END AS overall, checks FROM e JOIN cells USING (doc_id, place))
"""


@register("audit", AUDIT_SQL + "SELECT * FROM a")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    return plan.audit(briefs(spark, sf), *cases(spark, sf))


@register("offset_map", rf"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS m, regexp_split_to_array(text, '{WORDS}') AS g FROM documents),
x AS (SELECT doc_id, unnest(range(len(m))) AS n, m, g FROM m),
y AS (SELECT doc_id, n, m[n + 1] AS match, length(g[n + 1]) AS gap FROM x)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(sum(gap + length(match)) OVER w - length(match) AS BIGINT) AS start, CAST(sum(gap + length(match)) OVER w AS BIGINT) AS "end", match
FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY n)""")
def offset_map(spark: SparkSession, sf: str) -> DataFrame:
    """Words found in the text with its white space collapsed, put back to where they stand in the original."""
    rows = load(spark, sf, "documents").select("doc_id", text.collapse_map(F.col("text")).alias("c")).select("doc_id", "c.clean", "c.anchors")
    rows = rows.select("doc_id", "anchors", F.posexplode(text.match_spans(F.col("clean"), WORDS)).alias("n", "p"))
    return rows.select("doc_id", "n", text.to_original(F.col("anchors"), F.col("p.start")).alias("start"), (text.to_original(F.col("anchors"), F.col("p.end") - 1) + 1).alias("end"), "p.match")


@register("prose_lengths", r"""
SELECT doc_id, CAST(length(regexp_replace(regexp_replace(text, '\d+ [A-Z][A-Za-z0-9. ]{0,20} \d+|\([^)]*\d{4}\)|\b(Id|Ibid|supra|infra|at|v|See|Cf)\b\.?', ' ', 'g'), '[^A-Za-z]', '', 'g')) AS INTEGER) AS prose FROM documents WHERE lang = 'en'""")
def prose_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """English alone: word boundaries mean other things in the two regex dialects elsewhere."""
    return load(spark, sf, "documents").where("lang = 'en'").select("doc_id", text.prose_chars(F.col("text")).alias("prose"))


@register("word_counts", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{Nd}_]+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("n_words"))


@register("reporter_known", """
SELECT p_partkey, EXISTS (SELECT 1 FROM part d WHERE d.p_size > 40 AND d.p_type = p.p_type AND d.p_brand = p.p_brand) AS known, p_type = 'PROMO' AS non_case,
  CASE WHEN p_size % 3 = 1 OR p_type = 'PROMO' THEN 'N/A' WHEN EXISTS (SELECT 1 FROM part d WHERE d.p_size > 40 AND d.p_type = p.p_type AND d.p_brand = p.p_brand) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM part p""")
def reporter_known(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as reporters, listed without a blank and asked with one, in capitals and with a last dot."""
    p = load(spark, sf, "part").withColumn("reporter", F.expr("concat(p_type, ' ', replace(p_brand, '#', '. '))")).withColumn("source", F.expr("concat(p_type, '.')"))
    names = reporters.dictionary(p.where("p_size > 40").select(F.expr("array(concat(lower(p_type), ' ', replace(p_brand, '#', '.')))").alias("names")))
    journals = reporters.dictionary(p.where("p_type = 'PROMO'").select(F.lower("p_type").alias("name")))
    rows = reporters.non_case(reporters.known(p, "reporter", names), "source", journals)
    kind = F.expr("array('full_case', 'law', 'short_case')[p_size % 3]")
    return rows.select("p_partkey", "known", "non_case", reporters.local_check(kind, F.col("known"), F.col("non_case")).alias("verdict"))


@register("shadow_votes", r"""
SELECT event_id, CAST(event_id % 2 = 0 AS INT) + CAST(user_id % 3 = 0 AS INT) + CAST(value > 100 AS INT) >= 2 AS accepted, CASE WHEN value > 100 THEN CAST(1900 + event_id % 100 AS VARCHAR) END AS year FROM events""")
def shadow_votes(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat(event_type, ', ', user_id, ' X ', event_id, if(value > 100, concat(' (App. Div. ', 1900 + event_id % 100, ')'), ''))")
    return load(spark, sf, "events").select("event_id", reporters.shadow_votes(F.expr("event_id % 2 = 0"), F.expr("user_id % 3 = 0"), F.expr("value > 100")).alias("accepted"), reporters.own_year(raw).alias("year"))


VERSIONS_SQL = """
v AS (SELECT page_id, 0 AS ord, 'html_with_citations' AS field, html AS text FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 2, 'html', html FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 3, 'plain_text', url FROM pages)"""


def payload_versions(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("html_with_citations", "xml_harvard", "html", "plain_text")
    rows = load(spark, sf, "pages").selectExpr("page_id", "if(page_id % 3 = 0, html, null) AS html_with_citations", "'  \n' AS xml_harvard", "if(page_id % 2 = 0, html, '') AS html", "url AS plain_text")
    return archive.versions(rows, "page_id", fields)


@register("opinion_versions", f"WITH {VERSIONS_SQL} SELECT page_id, CAST(ord AS INTEGER) AS ord, field, md5(text) AS text_md5 FROM v")
def opinion_versions(spark: SparkSession, sf: str) -> DataFrame:
    return payload_versions(spark, sf).select("page_id", "ord", "field", F.md5("text").alias("text_md5"))


@register("best_versions", f"WITH {VERSIONS_SQL} SELECT page_id, arg_min(field, ord) AS field, md5(arg_min(text, ord)) AS text_md5, count(*) AS n_versions FROM v GROUP BY 1")
def best_versions(spark: SparkSession, sf: str) -> DataFrame:
    return archive.best_version(payload_versions(spark, sf), "page_id").select("page_id", "field", F.md5("text").alias("text_md5"), "n_versions")


@register("syllabi", r"""
WITH h AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE ' ' END AS field, replace(replace(html, '<title>', '<Syllabus id="s">'), '</title>', '</syllabus>') AS head FROM pages)
SELECT page_id, -page_id AS opinion_id, coalesce(nullif(trim(field), ''), nullif(trim(regexp_extract(head, '(?is)<syllabus[^>]*>(.*?)</syllabus>', 1)), '')) AS text FROM h""")
def syllabi(spark: SparkSession, sf: str) -> DataFrame:
    field, head = F.expr("if(page_id % 4 = 0, url, ' ')"), F.expr("""replace(replace(html, '<title>', '<Syllabus id="s">'), '</title>', '</syllabus>')""")
    clusters = load(spark, sf, "pages").select(F.col("page_id").alias("cluster_id"), archive.syllabus(field, head).alias("syllabus"))
    none = spark.createDataFrame([], "cluster_id long, opinion_id long, text string")
    return archive.with_syllabus(none, clusters).where("is_syllabus").select(F.col("cluster_id").alias("page_id"), "opinion_id", "text")


@register("cluster_opinions", """
SELECT o_orderkey AS cluster_id, count(l_orderkey) AS n_opinions, count(l_orderkey) >= o_custkey % 4 + 1 AS complete, any_value(CASE WHEN c_acctbal > 0 THEN c_nationkey END) AS court_id
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey, o_custkey""")
def cluster_opinions(spark: SparkSession, sf: str) -> DataFrame:
    clusters = load(spark, sf, "orders").selectExpr("o_orderkey AS cluster_id", "o_custkey % 4 + 1 AS n_expected", "o_custkey AS docket_id")
    dockets = load(spark, sf, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS docket_id", "c_nationkey AS court_id")
    got = archive.fetched(clusters, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cluster_id")))
    return archive.with_court(got, dockets).select("cluster_id", "n_opinions", "complete", "court_id")


@register("second_archive", """
WITH c AS (SELECT p_brand AS slug, p_size AS volume, p_partkey AS case_id, p_partkey % 300 AS cite_page, p_partkey % 280 + 1 AS first_page, p_partkey % 280 + 30 AS last_page FROM part),
a AS (SELECT o_orderkey AS ask_id, 'Brand#' || (o_orderkey % 25 + 1) AS slug, o_custkey % 50 + 1 AS volume, o_orderkey % 310 AS page, o_orderkey % 2 = 0 AS is_pincite FROM orders),
h AS (SELECT ask_id, case_id, 0 AS how FROM a JOIN c USING (slug, volume) WHERE page = cite_page UNION ALL SELECT ask_id, case_id, 1 FROM a JOIN c USING (slug, volume) WHERE page = first_page
  UNION ALL SELECT ask_id, case_id, 2 FROM a JOIN c USING (slug, volume) WHERE is_pincite AND page BETWEEN first_page AND last_page)
SELECT ask_id, b.case_id, ['exact', 'first_page', 'contained'][b.how + 1] AS how FROM a LEFT JOIN (SELECT ask_id, min({'how': how, 'case_id': case_id}) AS b FROM h GROUP BY 1) USING (ask_id)""")
def second_archive(spark: SparkSession, sf: str) -> DataFrame:
    known = load(spark, sf, "part").selectExpr("p_brand AS slug", "p_size AS volume", "p_partkey AS case_id", "p_partkey % 300 AS cite_page", "p_partkey % 280 + 1 AS first_page", "p_partkey % 280 + 30 AS last_page")
    asked = load(spark, sf, "orders").selectExpr("o_orderkey AS ask_id", "concat('Brand#', o_orderkey % 25 + 1) AS slug", "o_custkey % 50 + 1 AS volume", "o_orderkey % 310 AS page", "o_orderkey % 2 = 0 AS is_pincite")
    return archive.second_archive(asked, known)


RUNS_SQL = """
m AS (SELECT user_id AS doc, event_type AS reporter, CAST(floor(value) AS BIGINT) AS label, event_id AS "offset" FROM events),
k AS (SELECT * FROM (SELECT *, max(label) OVER (PARTITION BY doc, reporter ORDER BY "offset") AS top FROM m) WHERE label >= top),
g AS (SELECT *, label - lag(label) OVER (PARTITION BY doc, reporter ORDER BY "offset") AS gap FROM k),
runs AS (SELECT doc, reporter, count(*) AS n_marks, min(label) AS first, max(label) AS last, CAST(coalesce(count_if(gap > 1), 0) AS BIGINT) AS n_gaps FROM g GROUP BY 1, 2)"""


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    marks = load(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("reporter"), F.floor("value").alias("label"), F.col("event_id").alias("offset"))
    return archive.page_runs(marks, "doc")


@register("page_runs", f"WITH {RUNS_SQL} SELECT * FROM runs")
def page_runs(spark: SparkSession, sf: str) -> DataFrame:
    return event_runs(spark, sf)


@register("page_sequences", f"""WITH {RUNS_SQL}, a AS (SELECT DISTINCT user_id AS doc, CAST(event_id % 200 AS BIGINT) AS page FROM events WHERE event_type = 'click')
SELECT doc, page, arg_min(reporter, {{'no': NOT page BETWEEN first AND last, 'n': CASE WHEN page BETWEEN first AND last THEN 0 ELSE -n_marks END, 'r': reporter}}) AS reporter, bool_or(page BETWEEN first AND last) AS spans FROM a JOIN runs USING (doc) GROUP BY 1, 2""")
def page_sequences(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("doc"), (F.col("event_id") % 200).alias("page")).distinct()
    return archive.sequence_for(event_runs(spark, sf), asked, "doc")


@register("completeness", rf"""WITH {RUNS_SQL}, o AS (SELECT doc_id AS doc, text || CASE WHEN doc_id % 2 = 0 THEN ' It is so ordered.' ELSE '' END AS text, doc_id % 150 AS first_page FROM documents),
r AS (SELECT doc, arg_max({{'first': first, 'n_gaps': n_gaps}}, {{'n': n_marks, 'r': -list_position(['click', 'error', 'purchase', 'signup', 'view'], reporter)}}) AS r FROM runs WHERE n_marks >= 3 GROUP BY 1),
w AS (SELECT doc, CASE WHEN length(text) < 1500 THEN 'short' WHEN r.n_gaps > 0 THEN 'pages missing' WHEN r.first < first_page THEN 'begins before the case' WHEN doc % 2 <> 0 THEN 'no disposition' WHEN r IS NOT NULL THEN 'contiguous' ELSE 'disposition' END AS reason FROM o LEFT JOIN r USING (doc))
SELECT doc, reason IN ('contiguous', 'disposition') AS complete, reason FROM w""")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    opinions = load(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.expr("concat(text, if(doc_id % 2 = 0, ' It is so ordered.', ''))").alias("text"), (F.col("doc_id") % 150).alias("first_page"))
    rank = F.expr("array_position(array('click', 'error', 'purchase', 'signup', 'view'), reporter)")
    return archive.completeness(opinions, event_runs(spark, sf).withColumn("reporter", rank), "doc")


@register("marks_before", f"""WITH e AS ({EVENT_SPANS})
SELECT a.doc, a.id AS ask_id, (SELECT arg_max(m.id, {{'s': m.s, 'id': m.id}}) FROM e m WHERE m.doc = a.doc AND m.event_type = 'view' AND m.s <= a.s) AS label FROM e a WHERE a.event_type = 'click'""")
def marks_before(spark: SparkSession, sf: str) -> DataFrame:
    e = event_spans(spark, sf)
    marks = e.where("event_type = 'view'").groupBy("doc", F.col("s").alias("offset")).agg(F.max("id").alias("label"))
    return archive.mark_before(marks, e.where("event_type = 'click'").select("doc", F.col("id").alias("ask_id"), F.col("s").alias("offset")), "doc")


@register("page_neighbourhoods", """
SELECT a.conv_id, a.turn AS ask_id, md5(string_agg(p.text, chr(10) ORDER BY p.turn)) AS passage_md5 FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user' GROUP BY 1, 2""")
def page_neighbourhoods(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", F.col("turn").alias("ask_id"), F.col("turn").alias("page"))
    pages = c.select("conv_id", F.col("turn").alias("page"), F.col("text").alias("page_text"))
    return archive.around_page(pages, asked, "conv_id").select("conv_id", "ask_id", F.md5("passage").alias("passage_md5"))


@register("head_opinions", """
SELECT l_orderkey, arg_min(l_partkey, {'h': CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'F' THEN 0 ELSE 1 END, 'o': l_linenumber * 10000000 + l_partkey}) AS opinion_id FROM lineitem GROUP BY 1""")
def head_opinions(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey AS opinion_id", "l_returnflag = 'N' AS is_holding", "l_linestatus = 'F' AS is_syllabus", "l_linenumber * 10000000 + l_partkey AS ord")
    return archive.head_opinion(rows, "l_orderkey")


@register("resolved_candidates", """
WITH c AS (SELECT l_orderkey, l_partkey, l_discount * 10 >= 0.60 AND abs(year(o_orderdate) - year(l_shipdate)) <= 1 AS matches FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, count(*) AS n_candidates, CAST(count_if(matches) AS BIGINT) AS n_matching, CASE WHEN count_if(matches) = 1 THEN min(l_partkey) FILTER (matches) END AS cluster_id FROM c GROUP BY 1""")
def resolved_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    matches = archive.candidate_matches(F.col("l_discount") * 10, F.year("o_orderdate").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return archive.resolved(rows.select("l_orderkey", F.col("l_partkey").alias("cluster_id"), matches.alias("matches")), ["l_orderkey"])


@register("clean_records", """
SELECT user_id, CAST(count_if(event_type <> 'error') AS BIGINT) AS n, CAST(sum(event_id) FILTER (event_type <> 'error') AS BIGINT) AS ids FROM events GROUP BY 1""")
def clean_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are no objects, or have no id, are left out of a list; the rest stay."""
    item = F.expr("""if(event_type = 'error', if(event_id % 2 = 0, '"oops"', '{"id": "x"}'), concat('{"id": ', event_id, ', "case_name": "', event_type, '"}'))""")
    raw = load(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("raw"))
    rows = raw.select("user_id", archive.cleaned_clusters(F.col("raw")).alias("c"))
    return rows.select("user_id", F.size("c").cast("long").alias("n"), F.when(F.size("c") > 0, F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["id"])).alias("ids"))


@register("field_checks", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'N/A' WHEN c_acctbal < 0 THEN 'NOT_CHECKABLE' WHEN lower(c_mktsegment) = 'furniture' THEN 'PASS' ELSE 'FAIL' END AS court,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'PASS' ELSE 'NOT_CHECKABLE' END AS precedential FROM orders JOIN customer ON c_custkey = o_custkey""")
def field_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    asserted, actual = F.expr("if(o_orderstatus = 'P', null, 'Furniture')"), F.expr("if(c_acctbal < 0, null, c_mktsegment)")
    status = F.expr("CASE WHEN o_orderpriority LIKE '1%' THEN 'Published' WHEN o_orderpriority LIKE '2%' THEN 'Unpublished' END")
    return rows.select("o_orderkey", archive.court_verdict(asserted, actual).alias("court"), archive.precedential_verdict(status).alias("precedential"))


@register("best_names", """
SELECT l_orderkey, max(l_discount * 10) AS similarity, CASE WHEN max(l_discount * 10) >= 0.60 THEN 'PASS' WHEN max(l_discount * 10) >= 0.34 THEN 'NOT_CHECKABLE' ELSE 'FAIL' END AS verdict FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber <= 3 GROUP BY 1""")
def best_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber - 1 AS ord", "l_returnflag = 'R' AS corroborating", "cast(l_partkey as string) AS name", "l_discount * 10 AS similarity")
    return archive.best_name(rows, ["l_orderkey"]).select("l_orderkey", "similarity", V.name_verdict(F.col("similarity"), F.lit(2)).alias("verdict"))


@register("inherited_names", """
WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id - 1 END AS antecedent_id, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'N/A' ELSE 'PASS' END AS verdict FROM events)
SELECT e.id, CASE WHEN e.antecedent_id IS NULL THEN e.verdict WHEN p.verdict IS NULL OR p.verdict IN ('PENDING', 'N/A') THEN 'N/A' ELSE p.verdict END AS verdict FROM e LEFT JOIN e p ON p.id = e.antecedent_id""")
def inherited_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").selectExpr("event_id AS id", "if(event_id % 3 = 0, null, event_id - 1) AS antecedent_id", "CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'N/A' ELSE 'PASS' END AS verdict")
    return archive.inherit_name_check(rows).select("id", "verdict")


@register("treatment_links", "SELECT s_suppkey, 'NOT_CHECKABLE' AS verdict, CASE WHEN s_acctbal > 0 THEN '/?q=cites:(' || s_nationkey || ')' END AS link FROM supplier")
def treatment_links(spark: SparkSession, sf: str) -> DataFrame:
    return archive.treatment(load(spark, sf, "supplier").selectExpr("s_suppkey", "if(s_acctbal > 0, s_nationkey, null) AS cluster_id"), "cluster_id").select("s_suppkey", "verdict", "link")


def order_entries(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS citation_id", "if(o_orderstatus = 'P', null, o_orderpriority) AS authority_key", "if(o_orderkey % 5 = 0, 'unrecognized', 'full_case') AS kind")


@register("authorities", "SELECT o_custkey AS doc, o_orderpriority AS authority_key, count(*) AS n, min(o_orderkey) AS first_id FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def authorities(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.authorities(order_entries(spark, sf), "doc")


@register("run_totals", "SELECT o_custkey AS doc, count(*) AS citations, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) AS authorities, CAST(count_if(o_orderkey % 5 = 0) AS BIGINT) AS unparsed FROM orders GROUP BY 1")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.run_totals(order_entries(spark, sf), "doc")


@register("unexamined", f"WITH {OVERALL_SQL} SELECT l_orderkey FROM entries WHERE overall = 'UNVERIFIED'")
def unexamined(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.unexamined(entries(spark, sf)).select("l_orderkey")


@register("pending_checks", f"WITH {CHECKS_SQL} SELECT l_orderkey, arg_min(dimension, list_position(['reporter_valid', 'existence', 'case_name', 'court', 'year', 'quote', 'pincite'], dimension)) AS dimension, count(*) AS n FROM checks WHERE verdict = 'PENDING' GROUP BY 1")
def pending_checks(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.pending(checks(spark, sf), ["l_orderkey"])


@register("quote_accounting", """
SELECT l_orderkey, count(*) AS found, CAST(count_if(l_returnflag <> 'A') AS BIGINT) AS attributed, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS checked, CAST(count_if(l_returnflag = 'A') AS BIGINT) AS unattributed FROM lineitem GROUP BY 1""")
def quote_accounting(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem")
    return ledger.quote_accounting(rows, rows.where("l_returnflag <> 'A'"), rows.where("l_returnflag = 'N'"), "l_orderkey")


@register("sources_union", """
WITH s AS (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) * 2 + generate_subscripts([1, 2], 1) AS pos FROM lineitem),
f AS (SELECT l_orderkey, s, min(pos) AS pos FROM s GROUP BY 1, 2) SELECT l_orderkey, string_agg(s, ',' ORDER BY pos) AS sources FROM f GROUP BY 1""")
def sources_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.array("l_returnflag", "l_linestatus").alias("sources"))
    return ledger.sources_union(rows, ["l_orderkey"]).select("l_orderkey", F.array_join("sources", ",").alias("sources"))


@register("capped_reads", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 5 AS deferred FROM orders")
def capped_reads(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.capped(load(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 5).select("o_custkey", "o_orderkey", "deferred")


@register("listed_heads", """
SELECT o_custkey, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR)))[1:4], '; ') || CASE WHEN count(*) > 4 THEN '; and ' || (count(*) - 4) || ' more' ELSE '' END AS line FROM orders GROUP BY 1""")
def listed_heads(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("v"))
    return rows.select("o_custkey", ledger.listed_head(F.col("v"), 4).alias("line"))


@register("plain_report", f"""WITH {OVERALL_SQL}, b AS (SELECT l_orderkey, arg_min({{'d': dimension, 'v': verdict}}, {{'f': CASE WHEN verdict = 'FAIL' THEN 0 ELSE 1 END, 'o': list_position(['reporter_valid', 'existence', 'case_name', 'court', 'year', 'quote', 'pincite'], dimension), 'x': list_position(['AMBIGUOUS', 'FAIL', 'NOT_CHECKABLE', 'NOT_FOUND', 'OUT_OF_SCOPE'], verdict)}}) AS f FROM checks WHERE verdict NOT IN ('PASS', 'N/A', 'PENDING') GROUP BY 1)
SELECT l_orderkey, overall, CAST(list_position(['FLAGGED', 'REVIEW', 'UNVERIFIED', 'VERIFIED', 'PENDING'], overall) - 1 AS INTEGER) AS place, CASE WHEN f IS NULL THEN 'nothing was found against it' ELSE replace(f.d, '_', ' ') || ': ' || lower(replace(f.v, '_', ' ')) END AS line FROM entries LEFT JOIN b USING (l_orderkey)""")
def plain_report(spark: SparkSession, sf: str) -> DataFrame:
    first = checks(spark, sf).groupBy("l_orderkey", "dimension").agg(F.min_by("verdict", F.struct(F.when(F.col("verdict").isin(*ledger.NOT_PROBLEMS), 2).when(F.col("verdict") == "FAIL", 0).otherwise(1), "verdict")).alias("verdict"))
    return ledger.plain_lines(entries(spark, sf), first, ["l_orderkey"])


@register("scope_lines", """
WITH e AS (SELECT o_custkey, ['full_case', 'law', 'journal'][o_orderkey % 3 + 1] AS kind, ['PASS', 'NOT_FOUND', 'AMBIGUOUS', 'FAIL'][o_orderkey % 4 + 1] AS x FROM orders),
c AS (SELECT o_custkey, count(*) AS n, count_if(kind = 'full_case' AND x IN ('PASS', 'FAIL')) AS r, count_if(kind = 'full_case' AND x = 'NOT_FOUND') AS a, count_if(kind = 'full_case' AND x = 'AMBIGUOUS') AS i, count_if(kind = 'journal') AS j, count_if(kind = 'law') AS s FROM e GROUP BY 1)
SELECT o_custkey, n || ' citations: ' || r || ' reachable; ' || a || ' in no source; ' || i || ' ambiguous; ' || j || ' not consulted; ' || s || ' statutory' || CASE WHEN r + a + i > 0 AND a >= 0.15 * (r + a + i) THEN '. Many were in no source.' ELSE '.' END AS scope FROM c""")
def scope_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").selectExpr("o_custkey", "array('full_case', 'law', 'journal')[cast(o_orderkey % 3 as int)] AS kind", "array('PASS', 'NOT_FOUND', 'AMBIGUOUS', 'FAIL')[cast(o_orderkey % 4 as int)] AS existence")
    return ledger.scope(V.coverage(rows, ["o_custkey"]), "o_custkey")


@register("record", f"""WITH {OVERALL_SQL}, x AS (SELECT l_orderkey, string_agg(dimension || ': `' || verdict || '`', '; ' ORDER BY list_position(['FAIL', 'NOT_FOUND', 'AMBIGUOUS', 'NOT_CHECKABLE', 'OUT_OF_SCOPE', 'N/A', 'PASS'], verdict), list_position(['reporter_valid', 'existence', 'case_name', 'court', 'year', 'quote', 'pincite'], dimension)) FILTER (verdict <> 'PENDING') AS c FROM checks GROUP BY 1)
SELECT o_custkey, l_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) AS INTEGER) AS place, overall, coalesce(c, 'none decided') AS checks, sha256(c_name) AS sha256 FROM entries JOIN x USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def record(spark: SparkSession, sf: str) -> DataFrame:
    owner = load(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    rows = entries(spark, sf).join(owner, "l_orderkey").withColumn("position", F.col("l_orderkey"))
    cells = sinks.checks_cell(checks(spark, sf).join(owner, "l_orderkey"), ["o_custkey", "l_orderkey"])
    return ledger.record(rows, cells, ["o_custkey", "l_orderkey"], load(spark, sf, "customer").selectExpr("c_custkey AS o_custkey", "c_name AS text"), "o_custkey")


@register("console_lines", f"WITH {OVERALL_SQL} SELECT l_orderkey, rpad(overall, 11, ' ') || ' ' || l_orderkey AS line FROM entries WHERE overall <> 'VERIFIED'")
def console_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.console(entries(spark, sf).withColumn("citation_id", F.col("l_orderkey")), "l_orderkey")


@register("reading_provenance", "SELECT user_id, event_type AS backend, count(*) AS readings, CAST(count_if(value > 90) AS BIGINT) AS failed, CAST(count_if(event_id % 4 = 0) AS BIGINT) AS deferred FROM events GROUP BY 1, 2")
def reading_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.provenance(load(spark, sf, "events").selectExpr("user_id", "event_type AS backend", "value > 90 AS failed", "event_id % 4 = 0 AS deferred"), "user_id")


@register("resumed_run", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 2 = 1")
def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders")
    return ledger.remaining(rows.select("o_orderkey"), rows.where("o_orderstatus = 'F' and o_custkey % 2 = 0"), ["o_orderkey"])


@register("corpus_scores", """
SELECT l_returnflag, count(*) AS n, CAST(count_if(l_suppkey % 7 = 0) AS BIGINT) AS vendor_only, CAST(count_if(l_tax = 0 AND l_suppkey % 7 <> 0) AS BIGINT) AS unparsed, CAST(count_if(l_tax > 0 AND l_suppkey % 7 <> 0) AS BIGINT) AS checkable,
  CAST(count_if(l_tax > 0 AND l_suppkey % 7 <> 0 AND l_quantity > 40) AS BIGINT) AS flagged, round(coalesce(CAST(count_if(l_tax > 0 AND l_suppkey % 7 <> 0 AND l_quantity > 40) AS DOUBLE) / nullif(count_if(l_tax > 0 AND l_suppkey % 7 <> 0), 0), 0), 6) AS flagged_rate FROM lineitem GROUP BY 1""")
def corpus_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.corpus_scores(load(spark, sf, "lineitem").selectExpr("l_returnflag", "l_suppkey % 7 = 0 AS vendor", "l_tax > 0 AS parsed", "l_quantity > 40 AS flagged"), "l_returnflag")


@register("abstention_scores", f"""WITH {OVERALL_SQL}, x AS (SELECT l_orderkey, overall, (SELECT bool_or(dimension = 'existence' AND verdict = 'NOT_FOUND') FROM checks c WHERE c.l_orderkey = e.l_orderkey) AS absent FROM entries e)
SELECT count(*) AS n, CAST(count_if(absent) AS BIGINT) AS absent, CAST(count_if(absent AND overall = 'FLAGGED') AS BIGINT) AS accused, NOT bool_or(absent AND overall = 'FLAGGED') AS sound, round(CAST(count_if(absent) AS DOUBLE) / count(*), 6) AS absent_share,
  round(coalesce(CAST(count_if(absent AND overall = 'FLAGGED') AS DOUBLE) / nullif(count_if(absent), 0), 0), 6) AS accused_rate FROM x""")
def abstention_scores(spark: SparkSession, sf: str) -> DataFrame:
    existence = checks(spark, sf).groupBy("l_orderkey").agg(F.when(F.bool_or((F.col("dimension") == "existence") & (F.col("verdict") == "NOT_FOUND")), "NOT_FOUND").otherwise("PASS").alias("existence"))
    return ledger.abstention_scores(entries(spark, sf).join(existence, "l_orderkey"))


@register("ratio_summary", "SELECT l_returnflag, round(median(1 - l_discount), 6) AS median, round(min(1 - l_discount), 6) AS least, CAST(count_if(1 - l_discount = 1) AS BIGINT) AS perfect FROM lineitem GROUP BY 1")
def ratio_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.ratio_summary(load(spark, sf, "lineitem").select("l_returnflag", (1 - F.col("l_discount")).alias("ratio")), "l_returnflag", "ratio")


@register("yield_counts", "SELECT count(*) AS n_rows, count(s) AS segments, count(DISTINCT s) AS unique, count(s) - count(DISTINCT s) AS duplicates FROM (SELECT CASE WHEN l_tax > 0.01 THEN l_partkey END AS s FROM lineitem)")
def yield_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.yields(load(spark, sf, "lineitem").selectExpr("if(l_tax > 0.01, l_partkey, null) AS s"), "s")


@register("negative_overlaps", f"""WITH e AS ({EVENT_SPANS}), l AS (SELECT * FROM e WHERE event_type = 'signup'), r AS (SELECT DISTINCT doc, s, event_type FROM e WHERE event_type IN ('view', 'click'))
SELECT l.doc, l.id AS n_id, CAST(count(*) FILTER (r.event_type = 'view') AS BIGINT) AS flagged, CAST(count(*) FILTER (r.event_type = 'click') AS BIGINT) AS absent FROM l LEFT JOIN r ON r.doc = l.doc AND l.s < r.s + 100 AND r.s < l.s + 300 GROUP BY 1, 2""")
def negative_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    e = event_spans(spark, sf)
    negatives = e.where("event_type = 'signup'").selectExpr("doc", "id AS n_id", "s AS l_start", "s + 300 AS l_end")
    hits = e.where("event_type in ('view', 'click')").selectExpr("doc", "s AS r_start", "s + 100 AS r_end", "if(event_type = 'view', 'flagged', 'absent') AS state")
    return ledger.false_positives(negatives, hits, "doc")


@register("progress_rows", "SELECT * FROM (SELECT o_custkey, row_number() OVER w AS done, CAST(sum(o_orderkey) OVER w AS BIGINT) AS total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE done % 5 = 0")
def progress_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.progress(load(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderkey"), 5)


@register("reading_candidates", """
SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL AND n_chars >= 40 AND coalesce(quality, 1) = 1 AND doc_id % 4 <> 3""")
def reading_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    rows = rows.selectExpr("doc_id", "array('full_case', 'id', 'supra', 'law')[cast(doc_id % 4 as int)] AS kind", "text AS sentence", "source AS cluster_id", "if(quality = 0, if(doc_id % 2 = 0, 'FAIL', 'AMBIGUOUS'), null) AS case_name")
    return ledger.reading_candidates(rows).select("doc_id")


@register("reading_flags", "SELECT event_id, event_type = 'error' OR (event_type = 'view' AND value > 100) AS flag FROM events")
def reading_flags(spark: SparkSession, sf: str) -> DataFrame:
    verdict, confidence = F.expr("CASE event_type WHEN 'error' THEN 'CONTRADICTED' WHEN 'view' THEN 'PARTIAL' ELSE 'SUPPORTED' END"), F.expr("if(value > 100, 'high', 'low')")
    return load(spark, sf, "events").select("event_id", ledger.reading_flag(verdict, confidence).alias("flag"))


@register("browser_states", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'absent' WHEN l_discount * 10 < 0.34 THEN 'mismatch' WHEN abs(l_linenumber - 3) > 1 THEN 'yearoff' ELSE 'found' END AS state FROM lineitem""")
def browser_states(spark: SparkSession, sf: str) -> DataFrame:
    state = ledger.browser_state(F.col("l_returnflag") != "A", F.col("l_discount") * 10, F.col("l_linenumber") - 3)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"))


@register("state_tallies", "SELECT CASE WHEN l_returnflag = 'A' THEN 'absent' WHEN l_discount * 10 < 0.34 THEN 'mismatch' WHEN abs(l_linenumber - 3) > 1 THEN 'yearoff' ELSE 'found' END AS state, count(*) AS n FROM lineitem GROUP BY 1")
def state_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return browser_states(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@register("first_paragraphs", r"""
WITH f AS (SELECT conv_id, turn AS f_id, regexp_replace(substr(text, 5, 40), '\s+', ' ', 'g') AS t FROM conversations)
SELECT f.conv_id, f.f_id, (SELECT min(p.turn) FROM conversations p WHERE p.conv_id = f.conv_id AND contains(regexp_replace(p.text, '\s+', ' ', 'g'), trim(f.t))) AS paragraph FROM f""")
def first_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    findings = c.select("conv_id", F.col("turn").alias("f_id"), F.regexp_replace(F.substring("text", 5, 40), " ", "  ").alias("text"))
    return joins.first_paragraph(c.select("conv_id", F.col("turn").alias("paragraph"), "text"), findings, "conv_id")


@register("two_budgets", """
WITH RECURSIVE r AS (SELECT user_id, event_id, CAST(event_id % 30 + 1 AS BIGINT) AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, 0 AS w, 1 AS n, u AS s FROM r WHERE k = 1 UNION ALL
  SELECT r.user_id, r.event_id, r.k, CASE WHEN n < 5 AND s + u <= 60 THEN w ELSE w + 1 END, CASE WHEN n < 5 AND s + u <= 60 THEN n + 1 ELSE 1 END, CASE WHEN n < 5 AND s + u <= 60 THEN s + u ELSE u END FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, event_id, CAST(w AS BIGINT) AS "window" FROM f""")
def two_budgets(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").selectExpr("user_id", "event_id", "event_id % 30 + 1 AS units")
    return budgets.two_budgets(rows, "user_id", ["event_id"], "units", 5, 60)


@register("retry_plan", """
WITH a AS (SELECT event_id, user_id % 4 + 1 AS attempt, [200, 429, 503, 404][event_id % 4 + 1] AS status, CASE WHEN event_id % 8 = 1 THEN value * 5 END AS retry_after FROM events),
s AS (SELECT *, CASE WHEN status NOT IN (429, 503) THEN 'done' WHEN attempt >= 3 THEN 'give_up' ELSE 'wait' END AS state FROM a)
SELECT event_id, attempt, state, CASE WHEN state = 'wait' THEN least(coalesce(retry_after, pow(2, attempt - 1)), 300) END AS wait_seconds FROM s""")
def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").selectExpr("event_id", "user_id % 4 + 1 AS attempt", "array(200, 429, 503, 404)[cast(event_id % 4 as int)] AS status", "if(event_id % 8 = 1, value * 5, null) AS retry_after")
    return budgets.retry_plan(rows, ["event_id"])


@register("request_pacing", """
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, t, t AS sent FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.event_id, r.k, r.t, greatest(r.t, f.sent + 7200000000) FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, event_id, round((sent - t) / 1000000, 6) AS wait_seconds FROM f""")
def request_pacing(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("request_id"), "ts")
    return budgets.pacing(rows, "user_id", "ts", 7200).select("user_id", "event_id", "wait_seconds")


@register("cached_answers", """
WITH l AS (SELECT user_id, ts, [200, 404, 429, 300, -1][event_id % 5 + 1] AS status FROM events)
SELECT user_id, arg_max(status, {'t': ts, 's': status}) AS status FROM l WHERE status NOT IN (429, -1) AND (status = 200 OR ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) GROUP BY 1""")
def cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").selectExpr("user_id", "ts AS stored", "array(200, 404, 429, 300, -1)[cast(event_id % 5 as int)] AS status")
    return budgets.cached(rows, "user_id", F.lit("2024-01-31 00:00:00"))
