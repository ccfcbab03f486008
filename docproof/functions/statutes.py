"""Statute references: parsing, designators, description, link outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^\s*(\d+)\s+(U\.?S\.?C\.?|C\.?F\.?R\.?)(?:\s*§+)?\s*([0-9][0-9A-Za-z.\-]*?)((?:\([0-9A-Za-z]+\))*)\s*$"
LIST = r"§§|\d\s*,\s*\d|\bet seq|\bto\b"


def parse(raw: Column) -> Column:
    """code, title, section, subsection designators, declined (ranges and lists are declined)."""
    code = F.regexp_replace(F.upper(F.regexp_extract(raw, PATTERN, 2)), "[.]", "")
    declined = raw.rlike(LIST)
    ok = (code != "") & ~declined
    return F.struct(
        F.when(ok, code).alias("code"), F.when(ok, F.regexp_extract(raw, PATTERN, 1)).alias("title"), F.when(ok, F.regexp_extract(raw, PATTERN, 3)).alias("section"),
        F.when(ok, F.regexp_extract_all(F.regexp_extract(raw, PATTERN, 4), F.lit(r"\(([0-9A-Za-z]+)\)"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("subsection"),
        F.coalesce(declined, F.lit(False)).alias("declined"),
    )


def describe(ref: Column) -> Column:
    dotted = F.when(ref["code"] == "USC", "U.S.C.").when(ref["code"] == "CFR", "C.F.R.")
    return F.concat(ref["title"], F.lit(" "), dotted, F.lit(" § "), ref["section"], F.array_join(F.transform(ref["subsection"], lambda s: F.concat(F.lit("("), s, F.lit(")"))), ""))


def designators_in_order(found: str, wanted: str) -> Column:
    """Whether `wanted` is an ordered subsequence of `found` (both array columns)."""
    return F.expr(f"aggregate({found}, 0, (k, x) -> CASE WHEN k < size({wanted}) AND x = {wanted}[k] THEN k + 1 ELSE k END) = size({wanted})")


def link_state(status: Column) -> Column:
    """A redirect affirms, 400 denies, anything else says nothing."""
    return F.when(status.isin(301, 302, 303, 307, 308), "EXISTS").when(status == 400, "ABSENT").otherwise("UNVERIFIED")


def versions_state(status: Column, versions: Column) -> Column:
    return F.when((status == 200) & (versions > 0), "EXISTS").when(status == 200, "ABSENT").otherwise("UNVERIFIED")


def state_verdict(state: Column, dimension: str = "existence") -> Column:
    unknown = "NOT_FOUND" if dimension == "existence" else "NOT_CHECKABLE"
    return F.when(state == "EXISTS", "PASS").when(state == "ABSENT", "FAIL").otherwise(unknown)
