import io
import zipfile

import pandas as pd

from docproof.functions import statutes  # noqa: F401
from docproof.operators import windows
from docproof.sources import documents, records, sinks
from docproof.streaming import events as streams

BODY = '<?xml version="1.0"?><w:document><w:body><w:p><w:r><w:t>One &amp;</w:t></w:r><w:r><w:t xml:space="preserve"> two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'
NOTES = '<w:footnotes><w:footnote w:type="separator" w:id="0"><w:p><w:r><w:t>---</w:t></w:r></w:p></w:footnote><w:footnote w:id="1"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote></w:footnotes>'


def docx(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return data.getvalue()


def test_ingest(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"text \xff")
    (tmp_path / "b.docx").write_bytes(docx({"word/document.xml": BODY, "word/footnotes.xml": NOTES}))
    (tmp_path / "bomb.docx").write_bytes(docx({"word/document.xml": "0" * 5_000_000}))
    (tmp_path / "up.docx").write_bytes(docx({"word/document.xml": BODY, "../x": "y"}))
    (tmp_path / "entity.docx").write_bytes(docx({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]>' + BODY}))
    (tmp_path / "c.doc").write_bytes(b"old")
    (tmp_path / "~$b.docx").write_bytes(b"lock")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.ingest(spark, str(tmp_path)).collect()}
    assert rows["a.md"].text == "text �"
    assert rows["b.docx"].text.startswith("One & two\nthree") and rows["b.docx"].text[rows["b.docx"].footnotes[0].s : rows["b.docx"].footnotes[0].e] == "a note"
    assert all(rows[x].error and rows[x].text is None for x in ("bomb.docx", "up.docx", "entity.docx", "c.doc"))
    names = [r.path.rsplit("/", 1)[1] for r in documents.listed(spark, str(tmp_path)).collect()]
    assert names == ["a.md", "b.docx", "bomb.docx", "entity.docx", "up.docx"]


def test_page_map_and_warnings(spark):
    df = spark.createDataFrame([(1, 1, "ab"), (1, 2, " "), (1, 3, "cde")], "doc_id int, page int, text string")
    (row,) = documents.page_map(df).collect()
    assert row.text == "ab\n \ncde" and [(p.s, p.e, p.page) for p in row.page_map] == [(0, 2, 1), (3, 4, 2), (5, 8, 3)] and row.warnings == ["page 2 has no text"]


def test_lookup_marks_unechoed_keys(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",)], "citation string")
    archive = spark.createDataFrame([("a", 200)], "citation string, status int")
    assert sorted((r.citation, r.status) for r in records.lookup(wanted, archive).collect()) == [("a", 200), ("b", -1)]


def test_request_batches_hold_the_caps(spark):
    keys = spark.range(3000).selectExpr("concat('key', id, repeat('x', id % 500)) AS k")
    got = records.batches(keys, "k").toPandas()
    sizes = got.groupby(["shard", "by_items", "by_chars"]).k.agg(["count", lambda x: x.str.len().sum()])
    assert sizes["count"].max() <= 250 and sizes.iloc[:, 1].max() <= 64_000 and len(got) == 3000


def test_gold_spans_and_excerpts(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "see 1 U.S. 1 now", "filename": "f", "citations_in_segment": ["1 U.S. 1"], "list_hallucinations": {"1 U.S. 1": "w", "absent": "v"}}\n{"text": "t", "citations_in_segment": []}\n')
    scored, left = records.excerpts(spark, str(tmp_path / "x.jsonl"))
    assert scored.count() == 1 and left.count() == 1
    assert [(r.start, r.end) for r in records.gold_spans(scored).collect()] == [(4, 12)]


def test_cache_never_keeps_transient_answers(spark, tmp_path):
    sinks.write_cache(spark.createDataFrame([("a", 200), ("b", 429), ("c", -1), ("d", 404)], "citation string, status int"), str(tmp_path / "c"))
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [200, 404]


def test_page_texts_join_repeated_labels(spark):
    df = spark.createDataFrame([(1, "abcdefgh", "5", 0), (1, "abcdefgh", "6", 3), (1, "abcdefgh", "5", 6)], "doc int, text string, label string, offset int")
    assert sorted((r.label, r.page_text) for r in windows.page_texts(df, "doc", "text").collect()) == [("5", "abc gh"), ("6", "def")]


def batch_bucket(rows, capacity, seconds):
    kept, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [t for t in kept.get(r[1], []) if (r[2] - t).total_seconds() < seconds]
        out[r[0]] = len(own) < capacity
        kept[r[1]] = own + [r[2]] * out[r[0]]
    return out


def test_streams_equal_their_batch_twins(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("tumbling", streams.tumbling, "complete"), ("sliding", streams.sliding, "complete")):
        q = make(streams.stream(spark, str(tmp_path / "in"), batch)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(batch).collect()))


def test_token_bucket_equals_a_replay(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", __import__("pyspark").sql.functions.expr("user_id % 4")).withColumn("ts", __import__("pyspark").sql.functions.expr("cast(ts as timestamp)"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.token_bucket(streams.stream(spark, str(tmp_path / "in"), batch), "user_id", 3, 86_400).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.admitted for r in spark.table("bucket").collect()}
    want = batch_bucket([(r.event_id, r.user_id, pd.Timestamp(r.ts)) for r in batch.collect()], 3, 86_400)
    assert got == want and not all(got.values())


def test_requests_get_replies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"jsonrpc": "2.0", "id": "1", "method": "tools/list"}\n{"jsonrpc": "2.0", "method": "ping"}\nbroken\n{"jsonrpc": "2.0", "id": "2", "method": "nope"}\n')
    q = streams.serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    replies = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert len(replies) == 3 and sum("-32700" in r for r in replies) == 1 and sum("-32601" in r for r in replies) == 1
