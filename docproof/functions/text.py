"""Text expressions: normalisation, spans with offsets, quotations, sentences, pincites.

Everything is built from SQL functions except NFC, which Spark lacks. Offsets are code points from 0,
half-open.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signals that introduce a citation, longest first.
SIGNALS = ("see generally", "but see", "see also", "but cf.", "see, e.g.,", "accord", "contra", "compare", "cf.", "e.g.,", "see", "with")

NBSP = "       "
QUOTE_MARKS = '["“”]'


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, in Arrow batches."""
    return text.str.normalize("NFC")


def normalize(text: Column) -> Column:
    """Line ends to LF, hard spaces to blanks, soft hyphens out, emphasis marks masked by equally many blanks, blanks before a line end out."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.translate(F.translate(text, NBSP, " " * len(NBSP)), "­", "")
    text = F.translate(text, "*_", "  ")
    return F.regexp_replace(text, "[ \t]+\n", "\n")


#: White space as the reference formats mean it, Unicode's included, spelled out so that it does not depend on a regex dialect.
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Pieces of a text are summed in blocks of so many: offsets cost no shuffle and stay nearly linear in long texts.
SPAN_BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: an expression named twice inside a lambda would be evaluated twice."""
    return F.transform(F.array(value), use)[0]


def blocks(rows: Column) -> Column:
    """An array cut into arrays of SPAN_BLOCK elements."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / SPAN_BLOCK).cast("int")), lambda b: F.slice(rows, b * SPAN_BLOCK + 1, SPAN_BLOCK))
    return F.when(F.size(rows) > 0, cut).otherwise(F.slice(F.array(rows), 1, 0))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of start, end, flat, match for every match, in order, from the lengths of matches and of the pieces between them. flat is the
    start in the text with every match replaced by one character. Inside the row: right for repeated and null keys, no shuffle."""
    zero = F.lit(0).cast("long")
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("m"), m.alias("match")),
    )

    def after(at: Column, p: Column) -> list[Column]:
        return [(at["t"] + p["g"] + p["m"]).alias("t"), (at["f"] + p["g"] + F.when(p["m"] > 0, 1).otherwise(0)).alias("f")]

    def sums(block: Column) -> Column:
        return F.aggregate(block, F.struct(zero.alias("t"), zero.alias("f")), lambda a, p: F.struct(*after(a, p)))

    def begins(of: Column) -> Column:
        none = F.array().cast("array<struct<t:bigint,f:bigint>>")
        step = lambda a, b: F.struct((a["t"] + b["t"]).alias("t"), (a["f"] + b["f"]).alias("f"), F.concat(a["out"], F.array(F.struct(a["t"].alias("t"), a["f"].alias("f")))).alias("out"))
        return F.aggregate(F.transform(of, sums), F.struct(zero.alias("t"), zero.alias("f"), none.alias("out")), step)["out"]

    def inside(block: Column, at: Column) -> Column:
        none = F.array().cast("array<struct<start:bigint,end:bigint,flat:bigint,match:string>>")
        one = lambda a, p: F.struct((a["t"] + p["g"]).alias("start"), (a["t"] + p["g"] + p["m"]).alias("end"), (a["f"] + p["g"]).alias("flat"), p["match"].alias("match"))
        return F.aggregate(block, F.struct(at["t"].alias("t"), at["f"].alias("f"), none.alias("out")), lambda a, p: F.struct(*after(a, p), F.concat(a["out"], F.array(one(a, p))).alias("out")))["out"]

    found = bound(blocks_of(pieces), lambda of: F.flatten(F.zip_with(of, begins(of), inside)))
    return F.when(text.isNotNull(), F.filter(found, lambda x: x["match"].isNotNull()))


def blocks_of(rows: Column) -> Column:
    return bound(rows, blocks)


def collapse_map(text: Column) -> Column:
    """clean: the text with every run of white space as one blank; anchors (clean, original): from each anchor on, offsets in the
    two texts differ by a constant, up to the next."""
    runs = match_spans(text, WHITE + "{2,}")
    zero = F.lit(0).cast("long")
    anchors = F.concat(F.array(F.struct(zero.alias("clean"), zero.alias("original"))), F.transform(runs, lambda r: F.struct((r["flat"] + 1).alias("clean"), r["end"].alias("original"))))
    return F.struct(F.regexp_replace(text, WHITE + "+", " ").alias("clean"), anchors.alias("anchors"))


def to_original(anchors: Column, offset: Column) -> Column:
    """The offset in the original text of an offset in the clean one."""
    return bound(F.element_at(F.filter(anchors, lambda a: a["clean"] <= F.greatest(offset, F.lit(0))), -1), lambda a: a["original"] + F.greatest(offset, F.lit(0)) - a["clean"])


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def spans(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, n, start, end, match for every match."""
    return df.select(key, F.posexplode(match_spans(F.col(text), pattern)).alias("n", "p")).select(key, "n", "p.start", "p.end", "p.match")


def quote_ranges(text: Column) -> Column:
    """Array of s, e: the insides of quotations. Straight marks toggle, curly ones open and close; a curly mark opens anew."""
    found_type = "array<struct<s:bigint,e:bigint>>"
    closed = F.lit(-1).cast("long")

    def step(a: Column, m: Column) -> Column:
        opens = F.struct(m["start"].alias("open"), a["found"].alias("found"))
        closes = F.struct(closed.alias("open"), F.concat(a["found"], F.array(F.struct((a["open"] + 1).alias("s"), m["start"].alias("e")))).alias("found"))
        return F.when(m["match"] == "“", opens).when(a["open"] >= 0, closes).when(m["match"] == '"', opens).otherwise(a)

    def block(a: Column, of: Column) -> Column:
        own = F.aggregate(of, F.struct(a["open"].alias("open"), F.array().cast(found_type).alias("found")), step)
        return bound(own, lambda o: F.struct(o["open"].alias("open"), F.concat(a["found"], F.array(o["found"])).alias("found")))

    start = F.struct(closed.alias("open"), F.array().cast(f"array<{found_type}>").alias("found"))
    return F.flatten(F.aggregate(blocks_of(match_spans(text, QUOTE_MARKS)), start, block)["found"])


def quotations(df: DataFrame, key: str, text: str, least: int = 8, most: int = 600) -> DataFrame:
    """key, start, end, body of quotations whose bodies are within the length bounds; found inside each row."""
    inside = F.filter(quote_ranges(F.col(text)), lambda q: (q["e"] - q["s"]).between(least, most))
    bodies = F.transform(inside, lambda q: F.struct(q["s"].alias("start"), q["e"].alias("end"), F.substring(F.col(text), (q["s"] + 1).cast("int"), (q["e"] - q["s"]).cast("int")).alias("body")))
    return df.select(key, F.inline(bodies))


def normalize_quote(text: Column, drop_inline: bool = False) -> Column:
    """The form in which quotations are compared: hyphenated line breaks joined, punctuation folded, bracketed changes
    unwrapped, ellipses one mark, apostrophes out, quotation marks blank, lower case."""
    text = F.regexp_replace(F.translate(text, "­", ""), r"([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    text = F.translate(text, "–—‘’", "--''")
    text = F.regexp_replace(text, r"(?i)\s*[\(\[](emphasis|citations?|internal quotation marks|footnotes?)[^\)\]]*[\)\]]", " ")
    text = F.regexp_replace(text, r"\[?(\.\s*){3,4}\]?|…", " ␞ ")
    if drop_inline:
        text = F.regexp_replace(text, r"\d+ [A-Z][A-Za-z0-9. ]{0,20} \d+(, \d+)?( \([^)]*\))?", " ")
    text = F.regexp_replace(text, r"\[([^\]]*)\]", "$1")
    text = F.translate(F.translate(text, "'", ""), '"“”', "   ")
    return F.lower(F.regexp_replace(collapse(text), r"^[.,;: ]+|[.,;: ]+$", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\W+"), lambda w: w != "")


def segments_in_order(haystack: str, segments: str) -> Column:
    """Of two columns: the end offset of the last segment if all stand in this order, else null; a find at offset 0 is a find."""
    return F.expr(f"aggregate({segments}, 0, (at, s) -> CASE WHEN at IS NULL OR locate(s, {haystack}, at + 1) = 0 THEN NULL ELSE locate(s, {haystack}, at + 1) + length(s) - 1 END)")


def prose_chars(sentence: Column) -> Column:
    """Length without citation furniture."""
    bare = F.regexp_replace(sentence, r"\d+ [A-Z][A-Za-z0-9. ]{0,20} \d+|\([^)]*\d{4}\)|\b(Id|Ibid|supra|infra|at|v|See|Cf)\b\.?", " ")
    return F.length(F.regexp_replace(bare, r"[^A-Za-z]", ""))


def sentences(text: Column) -> Column:
    """Sentences, split behind a full stop, question or exclamation mark and at line breaks."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \t]+|\n+"), F.trim), lambda s: s != "")


def signal_before(text: Column, start: Column) -> Column:
    """The longest signal that ends within 40 characters before an offset."""
    head = F.lower(F.substring(text, F.greatest(F.lit(1), start - 39).cast("int"), F.least(start, F.lit(40)).cast("int")))
    longest = sorted(SIGNALS, key=len, reverse=True)
    return F.nullif(F.regexp_extract(F.rtrim(head), f"(?:{'|'.join(map(re.escape, longest))})\\z", 0), F.lit(""))


def first_page(pincite: Column) -> Column:
    return F.regexp_extract(pincite, r"(\d+)", 1).try_cast("int")


def pincite_pages(pincite: Column, most: int = 60) -> Column:
    """Pages of '459', '459-61, 470': an abbreviated end takes the start's leading digits."""
    parts = F.regexp_extract_all(pincite, F.lit(r"\d+(?:\s*-\s*\d+)?"), F.lit(0))

    def pages(part: Column) -> Column:
        low = F.regexp_extract(part, r"^(\d+)", 1)
        tail = F.regexp_extract(part, r"-\s*(\d+)", 1)
        high = F.when(tail == "", low).when(F.length(tail) < F.length(low), F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(tail)), tail)).otherwise(tail)
        a, b = low.cast("bigint"), high.cast("bigint")
        return F.when((b >= a) & (b - a <= most), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a))

    return F.array_distinct(F.flatten(F.transform(parts, pages)))


def flatten_for_output(text: Column, limit: int = 300) -> Column:
    """One printable line: control characters out, pipes and breaks blank, white space collapsed, cut with three dots."""
    line = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"[|\r\n]+", " ")
    line = F.trim(F.regexp_replace(line, WHITE + "+", " "))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 3)), F.lit("..."))).otherwise(line)


def strip_reasoning(reply: Column) -> Column:
    """Delimited scratchpads out, also those that lack their start or end."""
    reply = F.regexp_replace(reply, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    reply = F.regexp_replace(reply, r"(?is)^.*</think(?:ing)?>", "")
    return F.trim(F.regexp_replace(reply, r"(?is)<think(?:ing)?>.*$", ""))


def parse_answer(reply: Column) -> Column:
    """verdict, confidence, supporting_span, reasoning of the first JSON block; unknown verdicts and confidences become the cautious ones."""
    schema = "verdict string, confidence string, supporting_span string, reasoning string, signal_mismatch boolean"
    got = F.from_json(F.regexp_extract(strip_reasoning(reply), r"(?s)(\{.*\})", 1), schema)
    verdict = F.upper(got["verdict"])
    confidence = F.lower(got["confidence"])
    return F.struct(
        F.when(verdict.isin("SUPPORTED", "CONTRADICTED", "PARTIAL", "UNCLEAR"), verdict).otherwise("UNCLEAR").alias("verdict"),
        F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("low").alias("confidence"),
        got["supporting_span"].alias("supporting_span"), F.left(got["reasoning"], F.lit(600)).alias("reasoning"),
        F.coalesce(got["signal_mismatch"], F.lit(False)).alias("signal_mismatch"),
    )


def span_verified(span: Column, source: Column) -> Column:
    """A quoted span must stand in the source, blanks and case aside; an ellipsis is no proof."""
    flat = lambda c: F.lower(collapse(c))
    return F.coalesce((flat(span) != "") & ~span.rlike(r"\.\.\.|…") & flat(source).contains(flat(span)), F.lit(False))


def insert_section_symbols(text: Column) -> Column:
    """'42 USC 1983' to '42 U.S.C. § 1983'."""
    text = F.regexp_replace(text, r"([0-9]+) U\.?S\.?C\.? (?:§ ?)?([0-9])", "$1 U.S.C. § $2")
    return F.regexp_replace(text, r"([0-9]+) C\.?F\.?R\.? (?:§ ?)?([0-9])", "$1 C.F.R. § $2")
