"""Verdicts: routing, firewall, the monotone fold, rollup, and the checks of quotations, pages and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much a verdict asserts; a check may only fall, and FAIL stands.
STANDING = {"PASS": 5, "N/A": 4, "NOT_CHECKABLE": 3, "AMBIGUOUS": 3, "OUT_OF_SCOPE": 3, "NOT_FOUND": 2, "FAIL": 1, "PENDING": 0}
OVERALLS = ("FLAGGED", "UNVERIFIED", "REVIEW", "PENDING", "VERIFIED")
PLAIN_ORDER = ("FLAGGED", "REVIEW", "UNVERIFIED", "VERIFIED", "PENDING")
DIMENSIONS = ("reporter_valid", "existence", "case_name", "court", "year", "precedential", "jurisdiction", "quote", "quote_source", "quote_agreement", "pincite", "statute_subsection", "statute_currency", "proposition", "treatment")
VENDORS = ("wl", "westlaw", "lexis", "u.s. lexis", "u.s. app. lexis")


def ordinal(value: Column, names) -> Column:
    out = F.lit(len(names))
    for k, name in reversed(list(enumerate(names))):
        out = F.when(value == name, k).otherwise(out)
    return out


def standing(verdict: Column) -> Column:
    out = F.lit(0)
    for name, n in STANDING.items():
        out = F.when(verdict == name, n).otherwise(out)
    return out


def fold(proposals: DataFrame, keys: list[str]) -> DataFrame:
    """Applies proposals (stage_ord, seq, verdict, suppressed_by) in order: anything replaces PENDING; a suppressed check is
    frozen; FAIL yields to FAIL alone; otherwise the standing may only fall, and equals overwrite."""
    rows = proposals.withColumn("s", standing(F.col("verdict")))
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stage_ord", "seq", "verdict", "suppressed_by", "s"))).alias("p"))
    final = F.expr("""aggregate(slice(p, 2, greatest(size(p) - 1, 0)), p[0], (cur, new) -> CASE
        WHEN cur.verdict = 'PENDING' THEN new
        WHEN cur.suppressed_by IS NOT NULL THEN cur
        WHEN cur.verdict = 'FAIL' AND new.verdict <> 'FAIL' THEN cur
        WHEN new.s > cur.s THEN cur ELSE new END)""")
    return ordered.select(*keys, final.alias("f"), F.size("p").alias("n_proposals")).select(*keys, "f.verdict", "f.suppressed_by", "f.stage_ord", "n_proposals")


def rollup(checks: DataFrame, keys: list[str]) -> DataFrame:
    """One overall verdict for each entry, by precedence."""
    v = F.col("verdict")
    facts = checks.groupBy(*keys).agg(
        F.every(v == "PENDING").alias("all_pending"), F.bool_or(v == "FAIL").alias("any_fail"),
        F.bool_or((F.col("dimension") == "existence") & v.isin("NOT_FOUND", "OUT_OF_SCOPE")).alias("unverified"),
        F.bool_or(v.isin("NOT_CHECKABLE", "AMBIGUOUS", "PENDING")).alias("review"),
        F.bool_or(F.coalesce(F.col("confidence").isin("medium", "low"), F.lit(False))).alias("unsure"),
        F.every((v == "PASS") | (v == "N/A")).alias("passes"), F.bool_or(v == "PASS").alias("one_passes"),
    )
    overall = (
        F.when(F.col("all_pending"), "PENDING").when(F.col("any_fail"), "FLAGGED").when(F.col("unverified"), "UNVERIFIED")
        .when(F.col("review") | F.col("unsure"), "REVIEW").when(F.col("passes") & F.col("one_passes"), "VERIFIED").otherwise("REVIEW")
    )
    return facts.select(*keys, overall.alias("overall"))


def counts_filled(entries: DataFrame) -> DataFrame:
    """Entries for each overall verdict, zeros included."""
    names = entries.sparkSession.createDataFrame([(o,) for o in OVERALLS], "overall string")
    return names.join(entries.groupBy("overall").agg(F.count("*").alias("n")), "overall", "left").select("overall", F.coalesce("n", F.lit(0)).alias("n"))


def violations(checks: DataFrame) -> DataFrame:
    """Rows that break a constraint: a FAIL shows evidence, NOT_FOUND names sources, what can't be checked gives a reason."""
    v = F.col("verdict")
    broken = F.when((v == "FAIL") & (F.coalesce(F.trim("evidence"), F.lit("")) == ""), "evidence").when((v == "NOT_FOUND") & (F.coalesce(F.size("sources"), F.lit(0)) <= 0), "sources").when(v.isin("NOT_CHECKABLE", "OUT_OF_SCOPE") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "reason")
    return checks.withColumn("broken", broken).where("broken is not null")


def coverage(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Where each entry's existence was looked for (kind, existence): reachable counts PASS and FAIL alike."""
    bucket = (
        F.when(F.col("kind") == "law", "statutory").when(~F.col("kind").isin("full_case", "short_case", "supra", "id"), "not_consulted")
        .when(F.col("existence").isin("PASS", "FAIL"), "reachable").when(F.col("existence") == "NOT_FOUND", "absent").when(F.col("existence") == "AMBIGUOUS", "indeterminate").otherwise("not_consulted")
    )
    names = ("reachable", "absent", "indeterminate", "not_consulted", "statutory")
    out = entries.withColumn("bucket", bucket).groupBy(*keys).agg(F.count("*").alias("citations"), *[F.count_if(F.col("bucket") == n).alias(n) for n in names])
    asked = F.col("reachable") + F.col("absent") + F.col("indeterminate")
    return out.withColumn("rate", F.round(F.try_divide("reachable", asked), 6)).withColumn("headline", F.coalesce(F.try_divide("absent", asked) >= 0.15, F.lit(False)))


def vendor_only(reporter: Column) -> Column:
    low = F.lower(F.trim(reporter))
    return low.isin(*VENDORS) | low.contains("lexis") | low.endswith(" wl") | low.startswith("wl ")


def routing(kind: Column, existence: Column, non_case: Column, vendor: Column, reporter_verdict: Column, key: Column) -> Column:
    """What happens to an entry before any lookup, in this order."""
    return (
        F.when(kind.isin("short_case", "supra", "id"), "INHERIT").when(existence.isNotNull() & (existence != "PENDING"), "SET")
        .when(kind.isin("law", "journal") | non_case | vendor, "OUT_OF_SCOPE").when(reporter_verdict == "FAIL", "SUPPRESSED").when(key.isNull(), "NO_KEY").otherwise("LOOK_UP")
    )


def firewall(rows: DataFrame) -> DataFrame:
    """Check rows from a lookup's status (status, n_matching, name_asserted, local_reporter): absence is never a finding by itself."""
    s, n = F.col("status"), F.col("n_matching")

    def check(dimension: str, verdict: str, suppressed: str | None = None) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), F.lit(verdict).alias("verdict"), F.lit(suppressed).cast("string").alias("suppressed_by"))

    held = [check(d, "NOT_CHECKABLE", "existence") for d in ("case_name", "court", "year", "precedential")]
    found = (
        F.when(s == 200, F.array(check("existence", "PASS")))
        .when((s == 300) & (n == 1), F.array(check("existence", "PASS")))
        .when((s == 300) & (n == 0) & F.col("name_asserted"), F.array(check("existence", "AMBIGUOUS"), check("case_name", "FAIL")))
        .when(s == 300, F.array(check("existence", "AMBIGUOUS"), *held))
        .when(s == -1, F.array(check("existence", "NOT_CHECKABLE")))
        .when((s == 400) & (F.col("local_reporter") == "PASS"), F.array(check("existence", "NOT_CHECKABLE", "reporter_valid"), check("reporter_valid", "NOT_CHECKABLE")))
        .when(s == 400, F.array(check("existence", "NOT_CHECKABLE", "reporter_valid"), check("reporter_valid", "FAIL")))
        .otherwise(F.array(check("existence", "NOT_FOUND")))
    )
    return rows.withColumn("c", F.explode(found)).select(*rows.columns, "c.*")


def name_verdict(score: Column, n_tokens: Column) -> Column:
    return F.when(score >= 0.60, "PASS").when(n_tokens < 2, "NOT_CHECKABLE").when(score >= 0.34, "NOT_CHECKABLE").otherwise("FAIL")


def year_verdict(asserted: Column, filed: Column) -> Column:
    """Years as text; a malformed one can't be checked; one year apart is a reporting matter."""
    delta = F.abs(asserted.try_cast("int") - F.substring(filed, 1, 4).try_cast("int"))
    return F.when(delta.isNull(), "NOT_CHECKABLE").when(delta == 0, "PASS").when(delta == 1, "NOT_CHECKABLE").otherwise("FAIL")


def quote_verdicts(findings: DataFrame, keys: list[str], altered_at: float = 0.75, near: float = 0.60, least: int = 24) -> DataFrame:
    """quote verdict from findings: quote, found, similarity, substitution, ocr, complete, n_opinions."""
    f = findings.where(F.length("quote") >= least)
    unmatched = ~F.col("found") & (F.col("similarity") < near)
    facts = findings.select(*keys).distinct().join(
        f.groupBy(*keys).agg(
            F.max("n_opinions").alias("opinions"), F.bool_or(~F.col("found") & (F.col("similarity") >= altered_at) & F.col("substitution")).alias("altered"),
            F.bool_or(unmatched).alias("unmatched"), F.every("found").alias("all_found")), keys, "left")
    verdict = F.when(F.col("all_found").isNull(), "N/A").when(F.col("opinions") == 0, "NOT_CHECKABLE").when(F.col("altered"), "FAIL").when(F.col("unmatched"), "NOT_CHECKABLE").when(~F.col("all_found"), "NOT_CHECKABLE").otherwise("PASS")
    return facts.select(*keys, verdict.alias("verdict"))


def quote_source(located: Column, only: Column, signalled: Column, inside: Column) -> Column:
    """only: the single kind of writing a quotation was located in (syllabus, plurality, separate) or null."""
    return (
        F.when(~located, "N/A").when(only.isin("syllabus", "separate"), F.when(signalled, "PASS").otherwise("FAIL"))
        .when(only == "plurality", F.when(signalled, "PASS").otherwise("NOT_CHECKABLE")).when(inside, "NOT_CHECKABLE").otherwise("PASS")
    )


def pincite_verdict(pincite: Column, located: Column, low: Column, high: Column, n_marks: Column, tolerance: int = 1) -> Column:
    """FAIL only where the page lies outside the opinion."""
    return (
        F.when(pincite.isNull(), "N/A").when(n_marks == 0, "NOT_CHECKABLE").when(located.isNotNull() & (F.abs(located - pincite) <= tolerance), "PASS")
        .when(located.isNotNull() | (n_marks < 2), "NOT_CHECKABLE").when(pincite.between(low, high), "NOT_CHECKABLE").otherwise("FAIL")
    )


def proposition_verdict(verdict: Column, confidence: Column, verified: Column, mismatch: Column) -> Column:
    return F.when(~verified & verdict.isin("SUPPORTED", "CONTRADICTED"), "NOT_CHECKABLE").when(verdict == "CONTRADICTED", "FAIL").when((verdict == "SUPPORTED") & (confidence == "high") & ~mismatch, "PASS").otherwise("NOT_CHECKABLE")


def blocking(checks: DataFrame, keys: list[str]) -> DataFrame:
    """The first of reporter_valid, existence that keeps an entry from being resolved."""
    rows = checks.where(F.col("dimension").isin("reporter_valid", "existence") & ~F.col("verdict").isin("PASS", "N/A", "PENDING"))
    return rows.groupBy(*keys).agg(F.min_by("dimension", ordinal(F.col("dimension"), DIMENSIONS)).alias("blocked_by"))


def inherit(entries: DataFrame, key: str = "id", parent: str = "antecedent_id", column: str = "existence") -> DataFrame:
    """Back-references take the verdict of the entry their chain of antecedents ends at."""
    from docproof.operators.joins import walk

    roots = walk(entries, key, parent).select(F.col("node").alias(key), "root")
    heads = entries.select(F.col(key).alias("root"), F.col(column).alias("__head"))
    out = entries.join(roots, key).join(heads, "root", "left")
    return out.withColumn(column, F.when(F.col(parent).isNull(), F.col(column)).otherwise(F.coalesce("__head", F.lit("NOT_CHECKABLE")))).drop("__head", "root")
