"""Reporter abbreviations: keys, spellings, dictionaries, and what can be said of a citation from them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.functions.text import collapse
from docproof.sources.tables import sized_broadcast

# Government publications that are cited like cases.
PUBLICATIONS = (
    "Fed. Reg.", "FR", "Federal Register", "C.F.R.", "CFR", "Code of Federal Regulations", "Stat.", "Statutes at Large", "Pub. L.", "U.S.C.", "U.S.C.A.", "U.S.C.S.",
    "Cong. Rec.", "Congressional Record", "Op. O.L.C.", "Comp. Gen.",
)


def key(name: Column) -> Column:
    """Apostrophes straight, white space collapsed, lower case."""
    return F.lower(collapse(F.translate(name, "’ʼ", "''")))


def spellings(name: Column) -> Column:
    """The spellings under which a dictionary lists a name: as is, without blanks, without last dots, without either."""
    k = key(name)
    return without_blank(F.array(k, F.replace(k, F.lit(" "), F.lit("")), F.regexp_replace(k, r"\.+$", ""), F.regexp_replace(k, r"[. ]", "")))


def guesses(name: Column) -> Column:
    """The seven spellings under which a name is looked up before it counts as unknown."""
    k = key(name)
    return without_blank(F.array(
        k, F.regexp_replace(k, r"\.+$", ""), F.concat(k, F.lit(".")), F.replace(k, F.lit(". "), F.lit(".")), F.trim(F.replace(k, F.lit("."), F.lit(". "))),
        F.replace(k, F.lit(" "), F.lit("")), F.regexp_replace(k, r"\.(?=\S)", ". "),
    ))


def without_blank(names: Column) -> Column:
    return F.array_distinct(F.filter(names, lambda v: v != ""))


def dictionary(*lists: DataFrame) -> DataFrame:
    """One column `spelling` from one-column tables of names, or of lists of names; each once."""
    out = None
    for table in lists:
        (name, kind), = table.dtypes
        flat = table.select(F.explode(name).alias("name")) if kind.startswith("array") else table.select(F.col(name).alias("name"))
        rows = flat.select(F.explode(spellings(F.col("name"))).alias("spelling"))
        out = rows if out is None else out.union(rows)
    return out.distinct()


def listed(rows: DataFrame, column: str, names: DataFrame, tries, flag: str) -> DataFrame:
    """rows with `flag`: whether any spelling of the column's name is in the dictionary. Each distinct name is looked up once."""
    distinct = rows.select(F.col(column).alias("__name")).where(F.col(column).isNotNull()).distinct()
    hit = distinct.withColumn("spelling", F.explode(tries(F.col("__name")))).join(sized_broadcast(names), "spelling", "left_semi").select("__name").distinct().withColumn(flag, F.lit(True))
    return rows.join(hit, F.col(column) == F.col("__name"), "left").drop("__name").withColumn(flag, F.coalesce(flag, F.lit(False)))


def known(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    return listed(rows, column, names, guesses, "known")


def non_case(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Journals, codes and publications: never an unknown reporter."""
    return listed(rows, column, names, spellings, "non_case")


def local_check(kind: Column, known_: Column, non_case_: Column) -> Column:
    """reporter_valid, before anything is looked up: only case citations have a reporter to check."""
    return F.when(~kind.isin("full_case", "short_case", "unrecognized") | non_case_, "N/A").when(known_, "PASS").otherwise("FAIL")


def shadow_votes(comma_before: Column, case_marker: Column, year_paren: Column) -> Column:
    """A citation-shaped span counts if two of three signs stand around it."""
    return comma_before.cast("int") + case_marker.cast("int") + year_paren.cast("int") >= 2


def own_year(raw: Column) -> Column:
    """The year of the last parenthesis of a citation's own span."""
    return F.try_element_at(F.regexp_extract_all(raw, F.lit(r"\(([^()]*\b)?(1[6-9][0-9]{2}|20[0-9]{2})\)"), F.lit(2)), F.lit(-1))


def own_court(court: Column, labels: Column, raw: Column, implied: Column) -> Column:
    """A court is kept if one of its labels stands in the span or the reporter implies it."""
    return F.when(F.exists(labels, lambda x: F.contains(raw, x)) | F.coalesce(implied == court, F.lit(False)), court)


def own_party(name: Column, raw: Column) -> Column:
    """A party name is kept if it stands in the span and is no court-and-year fragment."""
    return F.when(F.contains(raw, name) & ~name.rlike(r"^\(?[A-Za-z0-9. ]*\b(1[6-9]|20)[0-9]{2}\)?$"), name)
