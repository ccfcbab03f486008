"""Joins against archives of opinions: clusters, versions, pages, second archives, ambiguous answers, and what metadata says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The text fields of an opinion in order of preference, and words that end one.
TEXT_FIELDS = ("html_with_citations", "html_columbia", "html_lawbox", "xml_harvard", "html_anon_2020", "html", "plain_text")
DISPOSITION = (
    r"(?i)\b(it is so ordered|so ordered|affirmed|reversed and remanded|reversed|vacated and remanded|vacated|remanded|dismissed|petition (is )?denied|writ (is )?denied"
    r"|judgment (of the [\w .]+ )?is (affirmed|reversed|vacated)|we (affirm|reverse|vacate|remand)|for the foregoing reasons)\b"
)
PUBLISHED = ("published", "precedential")


def versions(payloads: DataFrame, id_: str, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """One row for each populated text field of an opinion: id, ord, field, text. All are kept: a quotation is absent only if
    it is absent from each."""
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f).alias("field"), F.col(f).alias("text")) for k, f in enumerate(fields) if f in payloads.columns])
    return payloads.select(id_, F.inline(F.filter(listed, lambda v: F.coalesce(v["text"].rlike(r"\S"), F.lit(False)))))


def best_version(rows: DataFrame, id_: str) -> DataFrame:
    return rows.groupBy(id_).agg(F.min_by("field", "ord").alias("field"), F.min_by("text", "ord").alias("text"), F.count("*").alias("n_versions"))


def syllabus(field: Column, headmatter: Column) -> Column:
    """The syllabus of a cluster: its own field, or the element in its head matter."""
    marked = F.regexp_extract(F.coalesce(headmatter, F.lit("")), r"(?is)<syllabus[^>]*>(.*?)</syllabus>", 1)
    return F.coalesce(F.nullif(F.trim(field), F.lit("")), F.nullif(F.trim(marked), F.lit("")))


def with_syllabus(opinions: DataFrame, clusters: DataFrame) -> DataFrame:
    """opinions (cluster_id, opinion_id, text) and each cluster's syllabus as a row that is no holding."""
    heads = clusters.where("syllabus is not null").select("cluster_id", F.negate("cluster_id").alias("opinion_id"), F.col("syllabus").alias("text"), F.lit(True).alias("is_syllabus"))
    return opinions.select("cluster_id", "opinion_id", "text", F.lit(False).alias("is_syllabus")).unionByName(heads)


def fetched(clusters: DataFrame, opinions: DataFrame) -> DataFrame:
    """clusters (cluster_id, n_expected) with the opinions that were reachable; a cluster that lacks one is incomplete throughout."""
    got = opinions.groupBy("cluster_id").agg(F.count("*").alias("n_opinions"))
    out = clusters.join(got, "cluster_id", "left").withColumn("n_opinions", F.coalesce("n_opinions", F.lit(0).cast("long")))
    return out.withColumn("complete", F.col("n_opinions") >= F.col("n_expected"))


def with_court(rows: DataFrame, dockets: DataFrame) -> DataFrame:
    """Adds court_id by docket_id; a docket that can't be had leaves null, never a mismatch."""
    return rows.join(dockets.select("docket_id", "court_id").dropDuplicates(["docket_id"]), "docket_id", "left")


def alnum_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def second_archive(asked: DataFrame, cases: DataFrame) -> DataFrame:
    """asked (ask_id, slug, volume, page, is_pincite) with the case that answers: one that begins at the page as cited, else the first
    whose first page it is, else (for a pincite alone) the one whose pages hold it. cases: slug, volume, case_id, cite_page, first_page,
    last_page. The page range is met within (slug, volume), by buckets of pages."""
    keys = ["slug", "volume"]
    exact = asked.join(cases.select(*keys, F.col("cite_page").alias("page"), "case_id"), [*keys, "page"]).select("ask_id", "case_id", F.lit(0).alias("how"))
    first = asked.join(cases.select(*keys, F.col("first_page").alias("page"), "case_id"), [*keys, "page"]).select("ask_id", "case_id", F.lit(1).alias("how"))
    wide = cases.where("first_page is not null and last_page is not null").withColumn("b", F.explode(F.sequence(F.expr("first_page div 50"), F.expr("greatest(first_page, last_page) div 50"))))
    held = asked.where("is_pincite").withColumn("b", F.expr("page div 50")).join(wide, [*keys, "b"]).where("page between first_page and last_page").select("ask_id", "case_id", F.lit(2).alias("how"))
    best = F.min(F.struct("how", "case_id")).alias("b")
    names = F.array(*map(F.lit, ("exact", "first_page", "contained")))
    return asked.select("ask_id").join(exact.union(first).union(held).groupBy("ask_id").agg(best), "ask_id", "left").select("ask_id", "b.case_id", F.get(names, F.col("b.how")).alias("how"))


def page_runs(marks: DataFrame, doc: str) -> DataFrame:
    """Page labels (doc, reporter, label, offset) kept forward within each reporter's sequence: runs with their ends, marks and gaps."""
    order = W.partitionBy(doc, "reporter").orderBy("offset")
    kept = marks.withColumn("top", F.max("label").over(order.rowsBetween(W.unboundedPreceding, 0))).where("label >= top")
    kept = kept.withColumn("gap", F.col("label") - F.lag("label").over(order))
    return kept.groupBy(doc, "reporter").agg(F.count("*").alias("n_marks"), F.min("label").alias("first"), F.max("label").alias("last"), F.count_if(F.col("gap") > 1).alias("n_gaps"))


def completeness(opinions: DataFrame, runs: DataFrame, doc: str, least_chars: int = 1500, least_marks: int = 3, tail: float = 0.30) -> DataFrame:
    """doc, complete, reason. opinions: doc, text, first_page (where the case begins, or null). Too short a text is a fragment; the longest
    run of page marks must be contiguous and not begin before the case; the end must dispose of the case."""
    longest = runs.where(F.col("n_marks") >= least_marks).groupBy(doc).agg(F.max_by(F.struct("first", "n_gaps"), F.struct("n_marks", F.negate("reporter"))).alias("r"))
    start = F.floor(F.length("text") * (1 - tail)).cast("int")
    rows = opinions.join(longest, doc, "left").withColumn("disposed", F.substring("text", start + 1, F.length("text")).rlike(DISPOSITION))
    reason = (
        F.when(F.length("text") < least_chars, "short").when(F.col("r.n_gaps") > 0, "pages missing").when(F.col("r.first") < F.col("first_page"), "begins before the case")
        .when(~F.col("disposed"), "no disposition").when(F.col("r").isNotNull(), "contiguous").otherwise("disposition")
    )
    return rows.select(doc, reason.isin("contiguous", "disposition").alias("complete"), reason.alias("reason"))


def sequence_for(runs: DataFrame, asked: DataFrame, doc: str) -> DataFrame:
    """asked (doc, page) with the reporter whose run spans the page, the first if several do, else the longest run."""
    spans = F.col("page").between(F.col("first"), F.col("last"))
    pick = F.min(F.struct((~spans).alias("no"), F.when(spans, 0).otherwise(-F.col("n_marks")).alias("n"), "reporter")).alias("p")
    return asked.join(runs, doc).groupBy(doc, "page").agg(pick).select(doc, "page", "p.reporter", (~F.col("p.no")).alias("spans"))


def mark_before(marks: DataFrame, asked: DataFrame, doc: str) -> DataFrame:
    """asked (doc, ask_id, offset) with the label of the last page mark at or before the offset: one sort of both sides together."""
    both = marks.select(doc, "offset", F.lit(0).alias("side"), F.lit(None).cast("long").alias("ask_id"), "label").unionByName(asked.select(doc, "offset", F.lit(1).alias("side"), "ask_id", F.lit(None).cast("long").alias("label")))
    last = F.last("label", ignorenulls=True).over(W.partitionBy(doc).orderBy("offset", "side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("label", last).where("side = 1").select(doc, "ask_id", "label")


def around_page(pages: DataFrame, asked: DataFrame, doc: str, reach: int = 1) -> DataFrame:
    """asked (doc, ask_id, page) with the text of the pages within reach, in order: each page is dealt to the few pincites it serves."""
    near = pages.withColumn("want", F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach))).select(doc, F.col("want").alias("page"), F.col("page").alias("at"), "page_text")
    got = asked.join(near, [doc, "page"]).groupBy(doc, "ask_id").agg(F.array_sort(F.collect_list(F.struct("at", "page_text"))).alias("p"))
    return got.select(doc, "ask_id", F.array_join(F.transform("p", lambda x: x["page_text"]), "\n").alias("passage"))


def head_opinion(opinions: DataFrame, cluster: str) -> DataFrame:
    """Of each cluster the first opinion that is a holding and no syllabus, else its first."""
    order = F.struct(F.when(F.col("is_holding") & ~F.col("is_syllabus"), 0).otherwise(1), "ord")
    return opinions.groupBy(cluster).agg(F.min_by("opinion_id", order).alias("opinion_id"))


def candidate_matches(similarity: Column, asserted_year: Column, filed: Column) -> Column:
    """A cluster that an ambiguous citation may mean: its name is near enough and its year at most one off (or not comparable)."""
    delta = F.abs(asserted_year.try_cast("int") - F.substring(filed, 1, 4).try_cast("int"))
    return (similarity >= 0.60) & F.coalesce(delta <= 1, F.lit(True))


def resolved(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the number of candidate clusters, how many match, and the one that alone does. candidates: keys, cluster_id, matches."""
    c = candidates.groupBy(*keys).agg(F.count("*").alias("n_candidates"), F.count_if("matches").alias("n_matching"), F.min(F.when(F.col("matches"), F.col("cluster_id"))).alias("one"))
    return c.select(*keys, "n_candidates", "n_matching", F.when(F.col("n_matching") == 1, F.col("one")).alias("cluster_id"))


def cleaned_clusters(raw: Column) -> Column:
    """The records of a JSON list that are objects with an id; anything else in it is left out."""
    items = F.from_json(raw, "array<string>")
    shaped = F.transform(items, lambda x: F.struct(F.get_json_object(x, "$.id").try_cast("long").alias("id"), F.get_json_object(x, "$.case_name").alias("case_name"), F.get_json_object(x, "$.date_filed").alias("date_filed")))
    return F.filter(shaped, lambda c: c["id"].isNotNull())


def court_verdict(asserted: Column, actual: Column) -> Column:
    return F.when(asserted.isNull(), "N/A").when(actual.isNull(), "NOT_CHECKABLE").when(F.lower(asserted) == F.lower(actual), "PASS").otherwise("FAIL")


def precedential_verdict(status: Column) -> Column:
    return F.when(status.isNull(), "NOT_CHECKABLE").when(F.lower(status).isin(*PUBLISHED), "PASS").otherwise("NOT_CHECKABLE")


def best_name(scored: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """keys with the name most like the asserted one, of at most `most` of the archive's names and all that other sources corroborate.
    scored: keys, ord, corroborating, name, similarity."""
    best = F.max_by(F.struct("name", "similarity"), F.struct("similarity", F.negate("ord"))).alias("b")
    return scored.where(F.col("corroborating") | (F.col("ord") < most)).groupBy(*keys).agg(best).select(*keys, "b.name", "b.similarity")


def inherit_name_check(rows: DataFrame) -> DataFrame:
    """entries (id, antecedent_id, verdict): a short form takes its antecedent's case-name verdict; one that is pending or not applicable there is N/A."""
    parents = rows.select(F.col("id").alias("__p"), F.col("verdict").alias("__v"))
    taken = F.when(F.col("__v").isNull() | F.col("__v").isin("PENDING", "N/A"), "N/A").otherwise(F.col("__v"))
    return rows.join(parents, F.col("antecedent_id") == F.col("__p"), "left").withColumn("verdict", F.when(F.col("antecedent_id").isNull(), F.col("verdict")).otherwise(taken)).drop("__p", "__v")


def treatment(rows: DataFrame, cluster: str) -> DataFrame:
    """Later treatment is never checked: a constant verdict and the link a reader follows."""
    return rows.select(*rows.columns, F.lit("NOT_CHECKABLE").alias("verdict"), F.when(F.col(cluster).isNotNull(), F.concat(F.lit("/?q=cites:("), F.col(cluster).cast("string"), F.lit(")"))).alias("link"))
