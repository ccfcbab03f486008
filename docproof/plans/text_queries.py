"""Queries over texts, markup, names and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.functions import markup, names, statutes, text
from docproof.operators import joins
from docproof.registry import register
from docproof.sources.tables import load

WORDS = r"[A-Z][a-z]+"


@register("passage_in_document", r"""
SELECT d.doc_id, b.item_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS start, CAST(length(b.text) AS BIGINT) AS n_chars
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def passage_in_document(spark: SparkSession, sf: str) -> DataFrame:
    return joins.passages_in(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@register("passage_verdicts", r"""
WITH hit AS (SELECT b.item_id, count(*) AS n, min(d.doc_id) AS first_doc FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1)
SELECT b.item_id, coalesce(h.n, 0) AS n_documents, h.first_doc, CASE WHEN h.n IS NULL THEN 'NOT_FOUND' WHEN h.n = 1 THEN 'PASS' ELSE 'AMBIGUOUS' END AS verdict
FROM benchmark b LEFT JOIN hit h USING (item_id)""")
def passage_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    hit = passage_in_document(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    out = load(spark, sf, "benchmark").select("item_id").join(hit, "item_id", "left")
    verdict = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") == 1, "PASS").otherwise("AMBIGUOUS")
    return out.select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), "first_doc", verdict.alias("verdict"))


@register("span_offsets", rf"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS m, regexp_split_to_array(text, '{WORDS}') AS g FROM documents),
x AS (SELECT doc_id, unnest(range(len(m))) AS n, m, g FROM m),
y AS (SELECT doc_id, n, m[n + 1] AS match, length(g[n + 1]) AS gap FROM x)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(sum(gap + length(match)) OVER w - length(match) AS BIGINT) AS start, CAST(sum(gap + length(match)) OVER w AS BIGINT) AS "end", match
FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY n)""")
def span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return text.spans(load(spark, sf, "documents"), "doc_id", "text", WORDS)


@register("normalize_text", r"""
SELECT doc_id, md5(regexp_replace(translate(replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), '       ', '       '), chr(173), ''), '*_', '  '), '[ \t]+\n', chr(10), 'g')) AS text_md5 FROM documents""")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("text_md5"))


@register("nfc_text", "SELECT doc_id, md5(nfc_normalize(text)) AS text_md5 FROM documents")
def nfc_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(text.nfc("text")).alias("text_md5"))


@register("whitespace_collapse", r"SELECT doc_id, CAST(length(x) AS INTEGER) AS n_chars, md5(x) AS text_md5 FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS x FROM documents)")
def whitespace_collapse(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "documents").select("doc_id", text.collapse(F.col("text")).alias("x"))
    return x.select("doc_id", F.length("x").alias("n_chars"), F.md5("x").alias("text_md5"))


@register("quote_pairs", r"""
WITH RECURSIVE c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE text LIKE '%"%' OR text LIKE '%“%' OR text LIKE '%”%'),
m AS (SELECT doc_id, ch, CAST(pos AS BIGINT) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM c WHERE ch IN ('"', '“', '”')),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM (SELECT DISTINCT doc_id FROM m)
  UNION ALL SELECT m.doc_id, m.k, CASE WHEN ch = '“' THEN pos WHEN opened >= 0 THEN -1 WHEN ch = '"' THEN pos ELSE -1 END, CASE WHEN ch <> '“' AND opened >= 0 THEN opened + 1 END, CASE WHEN ch <> '“' AND opened >= 0 THEN pos END FROM r JOIN m ON m.doc_id = r.doc_id AND m.k = r.k + 1)
SELECT r.doc_id, s AS start, e AS "end", substr(text, s + 1, e - s) AS body FROM r JOIN documents USING (doc_id) WHERE e - s BETWEEN 8 AND 600""")
def quote_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The quotations that stand in the documents."""
    return text.quotations(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@register("quote_normal_forms", r"""
WITH a AS (SELECT item_id, regexp_replace(replace('[' || left(text, 1) || ']' || substr(text, 2) || ' . . . "Quoted" – end', chr(173), ''), '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g') AS t FROM benchmark),
b AS (SELECT item_id, regexp_replace(regexp_replace(translate(t, '–—‘’', '--' || chr(39) || chr(39)), '\[?(\.\s*){3,4}\]?|…', ' ␞ ', 'g'), '\[([^\]]*)\]', '\1', 'g') AS t FROM a)
SELECT item_id, lower(regexp_replace(trim(regexp_replace(translate(replace(t, chr(39), ''), '"“”', '   '), '[ \t\n\r\f\v]+', ' ', 'g')), '^[.,;: ]+|[.,;: ]+$', '', 'g')) AS normal FROM b""")
def quote_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Whole passages, with a bracketed first letter, an ellipsis, marks and a dash added."""
    t = F.concat(F.lit("["), F.left("text", F.lit(1)), F.lit("]"), F.expr("substring(text, 2)"), F.lit(' . . . "Quoted" – end'))
    return load(spark, sf, "benchmark").select("item_id", text.normalize_quote(t).alias("normal"))


@register("ellipsis_segments", r"""
WITH h AS (SELECT item_id, text, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM benchmark), p AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN a ELSE b END AS x, CASE WHEN item_id % 2 = 0 THEN b ELSE a END AS y FROM h)
SELECT item_id, strpos(text, x) > 0 AND strpos(substr(text, strpos(text, x) + length(x)), y) > 0 AS in_order FROM p""")
def ellipsis_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The halves of whole passages, every other time the second one first."""
    half = F.floor(F.length("text") / 2).cast("int")
    a, b = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    even = F.col("item_id") % 2 == 0
    rows = load(spark, sf, "benchmark").withColumn("parts", F.array(F.when(even, a).otherwise(b), F.when(even, b).otherwise(a)))
    return rows.select("item_id", text.segments_in_order("text", "parts").isNotNull().alias("in_order"))


@register("sentence_counts", r"""
SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')) AS INTEGER) AS n_sentences FROM documents""")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))



@register("pincite_pages", r"""
WITH p AS (SELECT c_custkey, CAST(c_custkey % 800 + 100 AS VARCHAR) || '-' || lpad(CAST((c_custkey + 6) % 100 AS VARCHAR), 2, '0') AS pin FROM customer),
x AS (SELECT c_custkey, pin, CAST(split_part(pin, '-', 1) AS BIGINT) AS a, CAST(left(split_part(pin, '-', 1), 1) || split_part(pin, '-', 2) AS BIGINT) AS b FROM p)
SELECT c_custkey, pin, CAST(a AS INTEGER) AS first_page, CASE WHEN b >= a AND b - a <= 60 THEN CAST(b - a + 1 AS INTEGER) ELSE 1 END AS n_pages FROM x""")
def pincite_pages(spark: SparkSession, sf: str) -> DataFrame:
    pin = F.expr("concat(cast(c_custkey % 800 + 100 as string), '-', lpad(cast((c_custkey + 6) % 100 as string), 2, '0'))")
    rows = load(spark, sf, "customer").select("c_custkey", pin.alias("pin"))
    return rows.select("c_custkey", "pin", text.first_page(F.col("pin")).alias("first_page"), F.size(text.pincite_pages(F.col("pin"))).alias("n_pages"))


@register("section_symbols", r"""
SELECT o_orderkey, CAST(o_orderkey % 50 + 1 AS VARCHAR) || ' U.S.C. § ' || CAST(o_custkey AS VARCHAR) AS fixed FROM orders""")
def section_symbols(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat(cast(o_orderkey % 50 + 1 as string), ' USC ', cast(o_custkey as string))")
    return load(spark, sf, "orders").select("o_orderkey", text.insert_section_symbols(raw).alias("fixed"))


@register("statute_parse", r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'USC' ELSE 'CFR' END AS code,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ' U.S.C. § ' ELSE ' C.F.R. § ' END || CAST(o_custkey AS VARCHAR) || '(b)(3)' END AS described, o_orderkey % 7 = 0 AS declined
FROM orders""")
def statute_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("concat(cast(o_orderkey % 50 + 1 as string), if(o_orderkey % 2 = 0, ' U.S.C. § ', ' CFR '), cast(o_custkey as string), if(o_orderkey % 7 = 0, ' to 12', '(b)(3)'))")
    ref = load(spark, sf, "orders").select("o_orderkey", statutes.parse(raw).alias("ref"))
    return ref.select("o_orderkey", F.col("ref.code").alias("code"), statutes.describe(F.col("ref")).alias("described"), F.col("ref.declined").alias("declined"))


@register("statute_states", r"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'EXISTS' WHEN 1 THEN 'ABSENT' ELSE 'UNVERIFIED' END AS state,
  CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'NOT_FOUND' END AS verdict FROM orders""")
def statute_states(spark: SparkSession, sf: str) -> DataFrame:
    status = F.expr("element_at(array(302, 400, 500, 200), cast(o_orderkey % 4 as int) + 1)")
    rows = load(spark, sf, "orders").select("o_orderkey", statutes.link_state(status).alias("state"))
    return rows.withColumn("verdict", statutes.state_verdict(F.col("state")))


@register("designators", r"""
SELECT l_orderkey, l_linenumber, (l_linenumber % 3 <> 2) AS present FROM lineitem""")
def designators(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("array('b', '3', 'A')").alias("found"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN array('b', 'A') WHEN 1 THEN array('3') ELSE array('A', 'b') END").alias("wanted"))
    return rows.select("l_orderkey", "l_linenumber", statutes.designators_in_order("found", "wanted").alias("present"))


@register("name_tokens", r"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'),
  lambda w: w <> '' AND w NOT IN ('the', 'of', 'and', 'a', 'an', 'et', 'al', 'in', 're', 'on', 'v', 'vs', 'versus', 'petitioner', 'estate', 'matter')))), ' ') AS tokens FROM part""")
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", F.array_join(names.tokens(F.col("p_name")), " ").alias("tokens"))


@register("name_overlap", r"""
WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM part)
SELECT a.p_partkey, round(CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / least(len(a.t), len(b.t)), 6) AS overlap FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1""")
def name_overlap(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "part").select("p_partkey", names.tokens(F.col("p_name")).alias("t"))
    b = t.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return t.join(b, "p_partkey").select("p_partkey", F.round(names.overlap(F.col("t"), F.col("u")), 6).alias("overlap"))


@register("name_similarity")
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    pairs = p.select("p_partkey", F.col("p_name").alias("asserted")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("actual")), "p_partkey")
    return names.scored(pairs, "asserted", "actual").select("p_partkey", "similarity")


@register("name_levenshtein", r"""
SELECT a.s_suppkey, CAST(levenshtein(a.s_name, b.s_name) AS INTEGER) AS distance FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1""")
def name_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    other = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("o"))
    return s.join(other, "s_suppkey").select("s_suppkey", F.levenshtein("s_name", "o").alias("distance"))


@register("passage_ngram_candidates", r"""
WITH a AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\r\f\v]+') AS w FROM documents) WHERE len(w) >= 6),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, least(41, len(w) - 4)), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM (SELECT item_id, regexp_split_to_array(text, '[ \t\n\r\f\v]+') AS w FROM benchmark) WHERE len(w) >= 6)
SELECT a.doc_id AS left_id, b.item_id AS right_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY 1, 2""")
def passage_ngram_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return joins.gram_candidates(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), 6)


HIDDEN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""
PLAIN_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&mdash;', '—'), '&ndash;', '–'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))"""


@register("html_flatten", rf"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace({HIDDEN_SQL}, '(?i)</?({markup.BLOCK})(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {PLAIN_SQL}), lambda x: x <> ''), chr(10)) AS text FROM t""")
def html_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", markup.flatten(F.col("html")).alias("text"))


@register("html_tag_counts", r"""
SELECT tag, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x))) AS tag FROM pages) GROUP BY 1""")
def html_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select(F.explode(markup.tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@register("page_links", r"""
SELECT page_id, CAST(len(l) AS INTEGER) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages)""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "pages").select("page_id", markup.links(F.col("html")).alias("l"))
    return x.select("page_id", F.size("l").alias("n_links"), F.array_join("l", " ").alias("links"))


@register("text_nodes", rf"""
WITH t AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array({HIDDEN_SQL}, '<[^>]*>'), lambda x: {PLAIN_SQL}), lambda x: length(x) >= 8) AS l FROM pages)
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n, unnest(l) AS node FROM t""")
def text_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.posexplode(markup.text_nodes(F.col("html"))).alias("n", "node"))


@register("answer_parse", r"""
SELECT event_id, CASE event_type WHEN 'view' THEN 'SUPPORTED' WHEN 'error' THEN 'CONTRADICTED' ELSE 'UNCLEAR' END AS verdict, CASE WHEN event_type = 'view' THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN event_type = 'view' THEN 'PASS' WHEN event_type = 'error' THEN 'FAIL' ELSE 'NOT_CHECKABLE' END AS check_verdict FROM events""")
def answer_parse(spark: SparkSession, sf: str) -> DataFrame:
    from docproof.operators.verdicts import proposition_verdict

    reply = F.expr("""concat('<think>I wonder {', event_type, '}</think> Here: ', '{"verdict": "', CASE event_type WHEN 'view' THEN 'supported' WHEN 'error' THEN 'CONTRADICTED' ELSE 'maybe' END, '", "confidence": "', if(event_type = 'view', 'High', 'sure'), '", "supporting_span": "a b"}')""")
    got = load(spark, sf, "events").select("event_id", text.parse_answer(reply).alias("a"))
    ok = text.span_verified(F.col("a.supporting_span"), F.lit("x A  b y"))
    return got.select("event_id", F.col("a.verdict").alias("verdict"), F.col("a.confidence").alias("confidence"), proposition_verdict(F.col("a.verdict"), F.col("a.confidence"), ok, F.col("a.signal_mismatch")).alias("check_verdict"))


@register("content_identity", r"SELECT doc_id, sha256(text) AS sha256, left(sha256(lower(trim(source))), 24) AS cache_key FROM documents")
def content_identity(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.left(F.sha2(F.lower(F.trim("source")), 256), F.lit(24)).alias("cache_key"))


@register("page_concat", r"""
WITH t AS (SELECT conv_id, role, turn, text || CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN chr(10) ELSE '' END AS part FROM conversations)
SELECT conv_id, role AS label, string_agg(part, ' ' ORDER BY turn) AS page_text FROM t GROUP BY 1, 2""")
def page_concat(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of a conversation as one text with a mark where each begins; a role's label returns again and again."""
    from docproof.operators import windows

    c = load(spark, sf, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("whole"))
    marks = c.select("conv_id", F.col("role").alias("label"), windows.offset_before(F.length("text") + 1, "conv_id", ["turn"]).alias("offset"))
    return windows.page_texts(marks.join(whole, "conv_id"), "conv_id", "whole")


@register("output_lines", r"""
SELECT doc_id, CASE WHEN length(x) > 300 THEN left(x, 297) || '...' ELSE x END AS line FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[|\r\n]+', ' ', 'g'),
  '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS x FROM documents)""")
def output_lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.flatten_for_output(F.col("text")).alias("line"))


@register("citation_extract", r"""
WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 999 + 1 AS VARCHAR) AS v, CAST(o_custkey % 9999 + 1 AS VARCHAR) AS p, CAST(1950 + o_custkey % 60 AS VARCHAR) AS y FROM orders)
SELECT doc_id, 'cite_0000' AS citation_id, 'full_case' AS kind, v || ' F.2d ' || p AS normalized, y AS year, 'Smith v. Jones' AS case_name, NULL AS antecedent_id FROM o
UNION ALL SELECT doc_id, 'cite_0001', 'id', NULL, NULL, NULL, 'cite_0000' FROM o
UNION ALL SELECT doc_id, 'cite_0002', 'law', v || ' U.S.C. § ' || p, NULL, NULL, NULL FROM o
UNION ALL SELECT doc_id, 'cite_0003', 'short_case', NULL, NULL, NULL, 'cite_0000' FROM o
UNION ALL SELECT doc_id, 'cite_0004', 'supra', NULL, NULL, NULL, 'cite_0000' FROM o""")
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    from docproof.operators import extract

    volume, page = "cast(o_orderkey % 999 + 1 as string)", "cast(o_custkey % 9999 + 1 as string)"
    body = f"concat('We follow Smith v. Jones, ', {volume}, ' F.2d ', {page}, ' (', cast(1950 + o_custkey % 60 as string), '). Id. at 12. Under ', {volume}, ' U.S.C. § ', {page}, ' so. ', {volume}, ' F.2d at 7. Jones, supra, at 9.')"
    docs = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(body).alias("text"))
    return extract.antecedents(extract.citations(docs)).select("doc_id", "citation_id", "kind", "normalized", "year", "case_name", "antecedent_id")


@register("quote_match")
def quote_match(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark passages with one word changed, against the documents that hold the passage."""
    from docproof.functions import quotes

    passages = load(spark, sf, "benchmark").select("item_id", F.concat(F.left("text", F.lit(80)), F.lit(" altered "), F.expr("substring(text, 90)")).alias("quote"))
    texts = passage_in_document(spark, sf).join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("item_id", F.col("doc_id").cast("string").alias("version"), "text")
    return quotes.checked(passages, texts, "item_id").select("item_id", "version", "similarity", "difference", "found")
