"""Document scans: text, Markdown and DOCX files by suffix, with guards against hostile archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIXES = ("md", "txt", "docx", "pdf")
# Caps of an archive's unpacked size, of one part, and of the ratio.
TOTAL_BYTES, PART_BYTES, RATIO = 300 << 20, 100 << 20, 200
SCHEMA = "path string, source_format string, text string, footnotes array<struct<s:int,e:int>>, error string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def listed(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Files of the known suffixes, without lock files and dotfiles, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kept = files.where(suffix(F.col("path")).isin(*SUFFIXES) & ~name.startswith("~$") & ~name.startswith("."))
    return kept.select("path", "length").orderBy("path")


def unsafe_xml(payload: Column) -> Column:
    return F.decode(F.substring(payload, 1, 4096), "ISO-8859-1").rlike(r"(?i)<!(DOCTYPE|ENTITY)")


def unsafe_member(name: Column) -> Column:
    """Absolute paths, drives and ways up."""
    return name.rlike(r"^([/\\]|[A-Za-z]:)") | F.exists(F.split(name, r"[/\\]"), lambda p: p == "..")


def refused(infos: list) -> str | None:
    """Judged by the central directory alone, before anything is unpacked."""
    total = 0
    for i in infos:
        total += i.file_size
        if re.match(r"[/\\]|[A-Za-z]:", i.filename) or ".." in re.split(r"[/\\]", i.filename):
            return f"unsafe member {i.filename}"
        if i.file_size > PART_BYTES:
            return f"part {i.filename} is too large"
        if i.file_size > RATIO * max(1, i.compress_size):
            return f"part {i.filename} is packed too tightly"
    return "archive is too large" if total > TOTAL_BYTES else None


def paragraphs(xml: bytes, footnotes: bool = False) -> list[str]:
    """Paragraph texts of a Word part; separator notes are skipped. Only known tags are read, no entities are defined."""
    if re.search(rb"(?i)<!(DOCTYPE|ENTITY)", xml[:4096]):
        raise ValueError("the part declares a document type")
    text = xml.decode("utf-8", "replace")
    if footnotes:
        text = re.sub(r'(?s)<w:(foot|end)note [^>]*w:type="[^"]*eparator"[^>]*>.*?</w:\1note>', "", text)
    out = []
    for body in re.findall(r"(?s)<w:p[ >].*?</w:p>", text):
        runs = re.findall(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>", body)
        out.append("".join(runs).replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&"))
    return out


def read_docx(content: bytes) -> tuple[str, list[tuple[int, int]]]:
    """Body paragraphs, then notes under a heading, and the spans of the notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if why := refused(z.infolist()):
            raise ValueError(why)
        names = set(z.namelist())
        text, spans = "\n".join(paragraphs(z.read("word/document.xml"))), []
        for part, label in (("word/footnotes.xml", "FOOTNOTES"), ("word/endnotes.xml", "ENDNOTES")):
            notes = [p for p in paragraphs(z.read(part), True) if p.strip()] if part in names else []
            if notes:
                text += f"\n\n===== {label} =====\n"
                for n in notes:
                    spans.append((len(text), len(text) + len(n)))
                    text += n + "\n"
    return text, spans


def _ingest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"], strict=True):
            kind = path.rsplit(".", 1)[-1].lower()
            try:
                if kind == "docx":
                    text, notes = read_docx(bytes(content))
                    rows.append((path, kind, text, [{"s": a, "e": b} for a, b in notes], None))
                elif kind in ("txt", "md"):
                    rows.append((path, kind, bytes(content).decode("utf-8", "replace"), [], None))
                else:
                    rows.append((path, kind, None, [], f"unsupported format {kind}"))
            except Exception as e:  # a broken file is a row with an error, not the end of the scan
                rows.append((path, kind, None, [], f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "source_format", "text", "footnotes", "error"])


def ingest(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, source_format, text, footnotes, error of every file; unsupported and refused files have an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", "content").mapInPandas(_ingest, SCHEMA)


def page_map(pages: DataFrame, doc: str = "doc_id", order: str = "page", text: str = "text") -> DataFrame:
    """Extracted pages to one text for each document and the half-open offsets of its pages; empty pages give a warning."""
    before = F.sum(F.length(text) + 1).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.length(text) - 1
    rows = pages.withColumn("s", before).withColumn("e", F.col("s") + F.length(text))
    packed = F.array_sort(F.collect_list(F.struct(order, "s", "e", text)))
    out = rows.groupBy(doc).agg(packed.alias("p"))
    return out.select(
        doc, F.array_join(F.transform("p", lambda x: x[text]), "\n").alias("text"), F.transform("p", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x[order].alias("page"))).alias("page_map"),
        F.transform(F.filter("p", lambda x: F.trim(x[text]) == ""), lambda x: F.concat(F.lit("page "), x[order].cast("string"), F.lit(" has no text"))).alias("warnings"),
    )


def page_of(pages: str, offset: str) -> Column:
    return F.expr(f"try_element_at(filter({pages}, p -> p.s <= {offset} AND {offset} < p.e), 1).page")
