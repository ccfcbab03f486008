import re

import pytest

from docproof.functions import markup, names, statutes, text


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_spans_equal_finditer(spark):
    texts = ["", "Ab cd Ef", "Éa Xy ZZ a Bc", "😀 Ab 😀Cd", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted((r.id, r.start, r.end, r.match) for r in text.spans(df, "id", "t", "[A-Z][a-z]").collect())
    assert got == sorted((k, m.start(), m.end(), m[0]) for k, t in enumerate(texts) if t for m in re.finditer("[A-Z][a-z]", t))


def test_quotations_pair_straight_and_curly(spark):
    t = 'a "first quote" b “second one” c "unclosed quote'
    df = spark.createDataFrame([(1, t)], "id int, t string")
    assert [r.body for r in text.quotations(df, "id", "t").orderBy("start").collect()] == ["first quote", "second one"]


def test_normalize_keeps_length_of_emphasis(spark):
    from pyspark.sql import functions as F

    (row,) = one(spark, [("a *b*\r\nc­d _e_ \t\nf",)], "t string", text.normalize(F.col("t")))
    assert row[0] == "a  b\ncd  e\nf"


def test_pincite_ranges(spark):
    from pyspark.sql import functions as F

    rows = [("459-61, 470",), ("12",), ("900-2000",), ("x",), (None,)]
    got = one(spark, rows, "p string", text.pincite_pages(F.col("p")))
    assert got == [([459, 460, 461, 470],), ([12],), ([900],), ([],), (None,)]


def test_span_interlock(spark):
    from pyspark.sql import functions as F

    rows = [("The  COURT held", "so the court\nheld that"), ("the ... held", "the ... held"), ("", "x"), (None, "x"), ("absent", "x")]
    assert [r[0] for r in one(spark, rows, "s string, d string", text.span_verified(F.col("s"), F.col("d")))] == [True, False, False, False, False]


def test_scratchpads_go(spark):
    from pyspark.sql import functions as F

    rows = [("<think>a</think> b",), ("orphan</think> c",), ("d <think>open",)]
    assert [r[0] for r in one(spark, rows, "s string", text.strip_reasoning(F.col("s")))] == ["b", "c", "d"]


@pytest.mark.parametrize(("a", "b", "want"), [
    ("Smith v. Jones", "Jones v. Smith", 1.0), ("Smith", "Smith v. Jones", 1.0), ("Ziglar v. Abbasi", "Zigler v. Abbasi", 1.0), ("", "Smith", 0.0), (None, "Smith", 0.0), ("In re the", "Smith", 0.0),
    ("State v. Ing", "State v. Pune", 0.3), ("United States v. Miller", "U.S. v. Miller", 1.0), ("United States", "U.S. v. Miller", 0.3), ("Alpha v. Beta", "Gamma v. Delta", 0.0),
    ("EPA v. Sackett", "Environmental Protection Agency v. Sackett", 1.0), ("NAACP v. Button", "National Association for the Advancement of Colored People v. Button", 1.0),
    ("Petitioner Acme versus State", "Acme v. State", 1.0), ("Harlow v. Fitzgerald", "Harlow v. Nixon", 0.5), ("Estate of Kay v. Dept. of Labor", "Kay v. Department of Labor", 1.0),
])
def test_name_similarity(spark, a, b, want):
    rows = spark.createDataFrame([(1, a, b), (2, b, a)], "id int, a string, b string")
    assert [r.similarity for r in names.scored(rows, "a", "b").collect()] == [pytest.approx(want, abs=1e-4)] * 2


def test_tokens_are_canonical(spark):
    from pyspark.sql import functions as F

    rows = [("In re Ass'n of Bros. & Co.",), ("U.S. v. Dept. of Educ.",), ("Petitioner Acme versus State, d/b/a Acme Services",), (None,)]
    assert [r[0] for r in one(spark, rows, "n string", names.tokens(F.col("n")))] == [["assn", "bros", "co"], ["dept", "educ", "us"], ["acme", "serv", "state"], None]


def test_spans_of_repeated_and_null_keys_and_many_matches(spark):
    texts = ["Ab x Cd", "yyyyyyy Ef", "Xy " * 2000 + "zz", "  Ab  \n\n Cd   Ef ", "", None]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (3, texts[5])]
    df = spark.createDataFrame(rows, "id int, t string")
    got = sorted(((r.id or 0), r.start, r.end, r.match) for r in text.spans(df, "id", "t", "[A-Z][a-z]").collect())
    assert got == sorted((i or 0, m.start(), m.end(), m[0]) for i, t in rows for m in re.finditer("[A-Z][a-z]", t or ""))
    quoted = spark.createDataFrame([(1, 'a "first quote" b'), (1, 'yyyyyyyyyy "second quote" b'), (None, '"abcdefghi"' * 700)], "id int, t string")
    bodies = [(r.id, r.body) for r in text.quotations(quoted, "id", "t").collect()]
    assert sorted(bodies, key=str) == sorted([(1, "first quote"), (1, "second quote"), *[(None, "abcdefghi")] * 700], key=str)


def test_offsets_of_collapsed_text_lead_back(spark):
    from pyspark.sql import functions as F

    texts = ["a  b\n\n\nc d", "  x", "x  ", " ", "", "a b", "é  😀\t\tz", " y  z " * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.collapse_map(F.col("t")).alias("c"))
    offsets = F.transform(F.sequence(F.lit(0), F.greatest(F.length("c.clean") - 1, F.lit(0))), lambda k: text.to_original(F.col("c.anchors"), k.cast("long")))
    for r in df.select("t", "c.clean", offsets.alias("o")).collect():
        clean, index, run = "", [], False
        for k, ch in enumerate(r.t):  # the map, character by character
            if not (ch.isspace() and run):
                clean += " " if ch.isspace() else ch
                index.append(k)
            run = ch.isspace()
        assert r.clean == clean and r.o == (index or [0])


def test_walk_keeps_its_bound(spark):
    from docproof.operators import joins

    rows = spark.createDataFrame([(k, k - 1 if k else None) for k in range(30)] + [(100, 101), (101, 100), (7, 3)], "id int, up int")
    for hops in (0, 1, 7, 10, 16, 40):
        got = {r.node: (r.root, r.hops) for r in joins.walk(rows, "id", "up", hops).collect()}
        want, parent = {}, {k: k - 1 for k in range(1, 30)} | {100: 101, 101: 100, 7: 3}
        for node in (*range(30), 100, 101):
            at, n = node, 0
            while n < hops and at in parent:
                at, n = parent[at], n + 1
            want[node] = (at, n)
        assert got == want


def test_statutes(spark):
    from pyspark.sql import functions as F

    rows = [("42 U.S.C. § 12112(b)(3)(A)",), ("29 CFR 1630.2(h)",), ("42 U.S.C. §§ 1981, 1983",), ("nonsense",)]
    got = one(spark, rows, "r string", statutes.describe(statutes.parse(F.col("r"))), statutes.parse(F.col("r"))["declined"])
    assert got == [("42 U.S.C. § 12112(b)(3)(A)", False), ("29 C.F.R. § 1630.2(h)", False), (None, True), (None, False)]


def test_markup(spark):
    from pyspark.sql import functions as F

    html = "<p>One &amp; two</p><script>var x;</script><!-- no --><div>three<br/>four</div><a href='u'>x</a>"
    assert one(spark, [(html,)], "h string", markup.flatten(F.col("h")), markup.links(F.col("h"))) == [("One & two\nthree\nfour\nx", ["u"])]


def whole_text_quotations(t):
    out, opened = [], -1
    for at, c in enumerate(t):
        if c == "“" or (c == '"' and opened < 0):
            opened = at
        elif c in '"”' and opened >= 0:
            if 8 <= at - opened - 1 <= 600:
                out.append((opened + 1, at, t[opened + 1 : at]))
            opened = -1
    return out


def test_quotation_queries_see_whole_texts(spark, tmp_path):
    from docproof import registry

    texts = ['short "but quoted" text', "x " * 200 + 'late "quotation number one", “and number two” and "tiny" and "' + "y" * 601 + '"', "“a “nested opening” closes” \"unclosed to the end", "", None]
    passage = " ".join(f"word{i}" for i in range(99)) + " End, Of It"
    spark.createDataFrame([*enumerate(texts), (9, f"before {passage} after")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = {n: registry.queries()[n](spark, str(tmp_path)).collect() for n in ("quote_pairs", "quote_normal_forms", "ellipsis_segments", "quote_match")}
    assert sorted((r.doc_id, r.start, r.end, r.body) for r in run["quote_pairs"]) == sorted((i, *q) for i, t in enumerate(texts) for q in whole_text_quotations(t or ""))
    assert run["quote_normal_forms"][0].normal == passage.lower() + " ␞ quoted - end"
    assert run["ellipsis_segments"][0].in_order
    assert run["quote_match"][0].similarity > 0.9 and run["quote_match"][0].difference == "substitution", run["quote_match"]


def test_reader_settings_fail_before_any_work(spark):
    from pyspark.sql import functions as F

    from docproof.functions import readers

    for bad in (("gpt",), ("local", "http://example.org:80"), ("command",)):
        with pytest.raises(ValueError):
            readers.backend(*bad)
    ask = readers.backend("local", "http://127.0.0.1:1234", lambda q: q[-3:])
    failing = readers.backend("command", ask=lambda q: q[10**9])
    df = spark.createDataFrame([("abc",), (None,)], "p string")
    question = readers.prompt(F.col("p"), F.lit(None).cast("string"), F.lit("x" * 70_000))
    assert len(df.select(question).first()[0]) == 60_000 + len("Does the opinion support the proposition? Answer in JSON.\nSignal: none\nProposition: abc\nOpinion:\n")
    assert [r[0] for r in df.select(readers.reading(ask, F.col("p"))).collect()] == ["abc", None]
    assert [[r[0] for r in df.select(readers.reading(x, F.col("p"))).collect()] for x in (failing, readers.backend("none"))] == [[None, None]] * 2
