"""Markup: flattening, links, tag counts, page marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.functions.text import collapse, spans

BLOCK = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|blockquote"
# Named entities that are unescaped.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}


def without_hidden(html: Column) -> Column:
    """Scripts, styles and comments out."""
    html = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    html = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", " ")


def unescape(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def flatten(html: Column) -> Column:
    """Visible text: block tags break lines, other tags vanish, entities become characters."""
    text = F.regexp_replace(without_hidden(html), rf"(?i)</?({BLOCK})(\s[^>]*)?/?>", "\n")
    text = unescape(F.regexp_replace(text, "<[^>]*>", ""))
    lines = F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: x != "")
    return F.array_join(lines, "\n")


def text_nodes(html: Column, least: int = 8) -> Column:
    nodes = F.transform(F.split(without_hidden(html), "<[^>]*>"), lambda x: collapse(unescape(x)))
    return F.filter(nodes, lambda x: F.length(x) >= least)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def tags(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)


def page_marks(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, label, offset in the text without marks, for [*123] and <page-number>123</page-number>."""
    pattern = r"\[\*\d+\]|<page-number[^>]*>\*?\d+</page-number>"
    found = spans(df, key, markup, pattern)
    return found.select(key, F.regexp_extract("match", r"(\d+)[^0-9]*$", 1).alias("label"), "n", "start", F.length("match").alias("width"))
