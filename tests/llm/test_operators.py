"""Each operator against a brute-force statement of its contract, on the small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("docproof.llm")

from docproof.llm import _passages as passages  # noqa: E402
from docproof.llm import components, fingerprints, licenses, mixing, neighbours, packing, shingles, substrings, suffixes, token_store, tokens, toxicity  # noqa: E402
from docproof.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from docproof.llm.tokens import default_vocabulary, encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, size int, row string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))
#: Nulls, empty and very long texts, repeated rows, equal ids, ties and columns whose names the operators use inside.
ROWS = [
    (1, None, None, None, None, 1, 1, "a"), (2, "", "en", "b", 0, 1, 1, "a"), (3, " \t\n", "en", "b", 3, 1, 1, "a"), (4, LONG, "en", "a", len(LONG), 1, 1, "a"), (5, LONG, "de", "a", len(LONG), 1, 1, "a"),
    (6, PASSAGE + " one two three", "en", "ä", 1, 1, 1, "a"), (7, "seven " + PASSAGE, "en", "z", 1, 1, 1, "a"), (7, "seven " + PASSAGE, "en", "z", 1, 1, 1, "a"), (8, "Short text. Licensed under CC BY-NC 4.0.", None, "z", 1, 1, 1, "a"),
    (9, "short TEXT. licensed under cc by-nc 4.0.", None, "", 1, 1, 1, "a"), (None, "no id " + PASSAGE, "fr", "b", 1, 1, 1, "a"), (10, "é😀 " * 60, "fr", "b", 1, 1, 1, "a"), (11, "a\x00b " * 80, "fr", None, 1, 1, 1, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()


def words(text):
    return (text or "").encode().split()


def removed_words(rows, n=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < i:
                gone[s : s + n] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_op1(spark, sf, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substrings"](spark, sf).collect()}
    assert got == removed_words(docs)


def test_op1_odd_rows(odd, none):
    rows = [(r[0] if r[0] is not None else 99, r[1]) for r in ROWS]
    want = removed_words(sorted(set(rows), key=lambda r: r[0]))
    got = [(r.doc_id if r.doc_id is not None else 99, (r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_text.encode()).hexdigest())) for r in substrings.dedup(odd).collect()]
    assert len(got) == len(ROWS) and all(v == want[k] for k, v in got)
    assert substrings.dedup(none).collect() == []


def like_words(n=10):
    """Two different words of 2**n letters that every polynomial hash modulo 2**64 takes for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_like_words_are_told_apart(spark):
    a, b = like_words()
    rows = [(1, " ".join([a] * 60)), (2, " ".join([b] * 60)), (3, " ".join([a, b] * 30)), (4, " ".join([b, a] * 30)), (5, " ".join([a] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substrings.dedup(df).collect()}
    assert got == removed_words(rows) and got[2][1] == 0 and got[5][1] == 60
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in shingles.similar(df).collect()) == sorted(brute_components(rows))


def test_like_texts_are_told_apart(spark):
    rows = [(2 * k + i, x + y) for k, n in enumerate((5, 6, 7, 8, 9)) for i, (x, y) in enumerate([like_words(n), like_words(n)[::-1]])]
    rows += [(100 + k, "q" * 30 + t + "z" * 30) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.dedup(df).collect()}
    assert got == removed_bytes(rows)


def removed_bytes(rows, n=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone[s : s + n] = True
            else:
                seen.add(b[s : s + n])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_op2(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_suffixes"](spark, sf).collect()}
    assert got == removed_bytes(docs)


def test_op2_odd_rows(spark, odd, none):
    periodic = spark.createDataFrame([(1, "a" * 500), (2, "ab" * 300), (3, "a" * 99), (4, "x" + "a" * 100), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.dedup(periodic).collect()}
    assert got == removed_bytes([(r.doc_id, r.text) for r in periodic.collect()])
    rows = [(r[0] if r[0] is not None else 99, r[1]) for r in ROWS]
    want = removed_bytes(sorted(set(rows), key=lambda r: r[0]))
    out = [(r.doc_id if r.doc_id is not None else 99, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.dedup(odd).collect()]
    assert len(out) == len(ROWS) and all(v == want[k][3] for k, v in out)
    assert suffixes.dedup(none).collect() == []


def test_entries_of_unique_ids_compress_in_many_buckets(spark):
    """each entry held a row's hash and whole numbers, which few entries a payload don't compress."""
    rng = np.random.default_rng(2)
    rows = [(10**6 + i, "".join(map(chr, rng.integers(97, 123, 3000)))) for i in range(300)]
    base = passages.base_rows(spark.createDataFrame([*rows, (None, "a"), (None, "b")], "doc_id long, text string")).select("doc", "row", "text").collect()
    assert {r.row for r in base if r.doc < 2**63 - 1} == {0} and len({r.row for r in base if r.doc == 2**63 - 1}) == 2
    part = pa.RecordBatch.from_pydict({k: [r[k] for r in base] for k in ("doc", "row", "text")})
    rows = [p for b in passages.sender(suffixes.anchors(100), 2400, True, 0)(iter([part])) for k, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if k == 0]
    n = sum(len(passages.unpack([p])["h"]) for p in rows)
    assert n > 20_000 and len(pa.compress(b"".join(rows), codec="lz4_raw", asbytes=True)) < 27 * n


@pytest.mark.parametrize(("block", "hold"), [(400, 2000), (400, 1 << 20), (1 << 20, 700)])
def test_op2_in_small_blocks(spark, sf, docs, block, hold):
    """One passage in many surroundings, some of them alike, over several blocks and parts of a bucket; then real texts."""
    rng = np.random.default_rng(4)
    passage, sides = "The very same passage stands in all of these texts, wherever one looks for it.", ["".join(rng.choice(list("abcdefgh "), 90)) for _ in range(40)]
    rows = [(k, sides[int(rng.integers(40))] + passage + sides[int(rng.integers(40))]) for k in range(300)]
    for some in (rows, docs[:60]):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.dedup(df, block=block, hold=hold).collect()}
        assert got == removed_bytes(some)


def test_suffix_sorter_against_sorting(spark):
    from docproof.llm.suffix_sort import _loader

    sorter = _loader(spark).loadClass("docproof.SuffixGroups")
    rng = np.random.default_rng(3)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ints = jvm.java.lang.Integer.TYPE
    kinds = gateway.new_array(jvm.java.lang.Class, 2)
    probe = gateway.new_array(gateway.jvm.int, 1)
    kinds[0], kinds[1] = probe.getClass(), ints
    method = sorter.getMethod("sort", kinds)
    random = [rng.integers(1, 4, rng.integers(1, 25)).tolist() for _ in range(40)]
    words = [1, 2]
    for _ in range(9):  # Fibonacci and Thue-Morse words, runs and periods: suffixes that agree for long
        words = [words, words + words[: len(words) * 2 // 3]][1]
    morse = [1 + bin(k).count("1") % 2 for k in range(256)]
    long = [[1] * 300, [1, 2] * 150, [2, 1, 1] * 100 + [2, 1], words[:400], morse, [*range(1, 200)], [*range(200, 0, -1)], [1] * 150 + [2] + [1] * 150]
    for t in [*random, *long]:
        t = [*t, 0]
        array = gateway.new_array(gateway.jvm.int, len(t))
        for k, x in enumerate(t):
            array[k] = x
        args = gateway.new_array(jvm.java.lang.Object, 2)
        args[0], args[1] = array, max(t) + 1
        assert list(method.invoke(None, args)) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_word_encoder_equals_the_library(library):
    texts = ["", "  ", LONG[:2000], "Ça ÉTÉ ßtraße don't it's 'll <|endoftext|>x á İstanbul ΣΑΣ 日本語 12a3 a\x00b _x_ x.y... ð× a×b ÷ é!! #$%", "x y z"]
    ids, ends = encoder(default_vocabulary()).encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library(t).tolist() for t in texts]


def test_word_encoder_forgets_and_learns_again(library):
    small = encoder(default_vocabulary(), 10)
    for k in range(5):
        text = " ".join(f"word{k * 7 + i}" for i in range(30))
        assert small.encode([text.encode()])[0].tolist() == library(text).tolist()


def test_word_encoder_learns_each_piece_once():
    enc = tokens.WordEncoder(default_vocabulary(), 600_000)
    asked = []
    learn = enc.learn
    enc.learn = lambda pieces, other: asked.extend(pieces) or learn(pieces, other)
    for text in ("Word word. WORD, (word)", "été ÉTÉ, Été. 12 21 word", "it's <|endoftext|>, word", "It's word."):
        enc.encode([text.encode()])
    plain = ["word", ".", ",", "(", ")", "été", "1", "2"]
    assert sorted(asked) == sorted(x.encode() for x in [*plain, "it's", "It's", "<|endoftext|>,"])


def test_word_encoder_cuts_as_the_library(library):
    enc, r = tokens.WordEncoder(default_vocabulary(), 600_000), np.random.default_rng(3)
    texts = ["J\u030c \u1e96 i\u0307", "a\u0301 x\x85y \x1c", "ΟΔΟΣ ÀÉ×÷ÿßŸ", "a1b22.3,,x", "ABC's'T don't", "<|startoftext|>x|y<z", "日本語 テスト。", "\x00a\x7f", ""]
    texts += ["".join(r.choice(list("aZzÉéß×÷' .,!?<|>01\t\n\u0301日İΣ_-\"stdlm"), 60)) for _ in range(300)]
    ids, ends = enc.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, ends)] == [*(library(t).tolist() for t in texts), []]
    broken = [b"\xc3", b"\xc3 \x80 \xc3\xc3\x80 a\xff"]
    ids, ends = enc.encode(broken)
    assert [x.tolist() for x in np.split(ids, ends)] == [*(library(t.decode("utf-8", "replace")).tolist() for t in broken), []]


def test_op3(spark, sf, docs, library):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_store"](spark, sf).collect()}
    start = 0
    for i, t in docs:
        ids = library(t)
        assert got.pop(i) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_op3_odd_rows_and_damage(spark, odd, none, library, tmp_path):
    name = token_store.write(odd, f"file://{tmp_path}/s")
    index = token_store.read_index(spark, f"file://{tmp_path}/s").collect()
    ids = {bytes(r.root): np.frombuffer(r.ids, "<u4") for r in token_store.read_ids(spark, f"file://{tmp_path}/s", name).collect()}
    assert Counter(r.doc_id for r in index) == Counter(r[0] for r in ROWS)
    texts = defaultdict(list)
    for r in ROWS:
        texts[r[0]].append(library(r[1]).tolist())
    start = 0
    for r in sorted(index, key=lambda r: r.start):
        assert r.start == start and ids[bytes(r.root)].tolist() in texts[r.doc_id]
        start += r.n_tokens
    chunks = spark.table(name).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = token_store.write(none, f"file://{tmp_path}/e")
    assert token_store.read_ids(spark, f"file://{tmp_path}/e", empty).count() == 0
    manifest = spark.read.parquet(f"file://{tmp_path}/s/manifest").withColumn("root", __import__("pyspark").sql.functions.lit("x")).collect()
    spark.createDataFrame(manifest).write.mode("overwrite").parquet(f"file://{tmp_path}/s/manifest")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_index(spark, f"file://{tmp_path}/s")


def test_op4(spark, sf):
    got = QUERIES["op4_neighbours"](spark, sf).toPandas()
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and ids[q] not in set(own.vec_id)
        np.testing.assert_allclose(own.score, [x[np.searchsorted(ids, v)] @ x[q] for v in own.vec_id], rtol=1e-12)
        hits += len(set(best) & set(own.vec_id))
        total += 20
    assert hits / total >= 0.9


def test_op4_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id % 20 = 0"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 2, 0.5)]
    assert neighbours.search(df.limit(0), df.limit(0)).collect() == []


def test_op4_rows_that_share_an_id(spark):
    """The smallest vector of an id counts, whatever the order and the partitions."""
    rows = [(0, [1.0, 0.0]), (1, [0.9, 5.0]), (1, [0.2, 9.0]), (2, [0.5, 0.0]), (0, [3.0, 3.0])]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>").repartition(4)
        assert [(r.query_id, r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 2, 0.5), (0, 1, 0.2)]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [(i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def test_op5(spark, sf, docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op5_shingles"](spark, sf).collect()]
    assert sorted(got) == sorted(brute_components(docs))


def test_op5_odd_rows(odd, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in shingles.similar(odd).collect())
    assert got == Counter(brute_components([r[:2] for r in ROWS]))
    assert shingles.similar(none).collect() == []


@pytest.mark.parametrize("block", [4, 512])
def test_op5_chains_and_hot_groups(spark, monkeypatch, block):
    """A chain of near copies whose ends are far apart, and a group with long index lists, in small blocks."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = np.random.default_rng(1)
    base, rows = [f"b{i}" for i in range(120)], []
    for k in range(60):
        base = list(base)
        base[int(rng.integers(120))] = f"n{k}"
        rows.append((k, " ".join(base)))
    hot = [f"h{i}" for i in range(100)]
    for k in range(60, 110):
        own = list(hot)
        for at in rng.choice(100, int(rng.integers(0, 5)), replace=False):
            own[at] = f"m{k}_{at}"
        rows.append((k, " ".join(own[: int(rng.integers(60, 101))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in shingles.similar(df).collect()) == sorted(brute_components(rows))


def test_op5_entries_stay_small_in_many_buckets(spark):
    """with many buckets a payload has few entries, and each then took 36 bytes; 1.5 times the input at 2.6 GB."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(map(str, rng.integers(0, 10**6, 400)))) for i in range(200)]
    part = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    counts = type("Counts", (), {"value": np.zeros(1 << shingles.COUNTER_BITS, np.uint32)})
    sent = [p for b in shingles.prefix_entries(counts, 2400)(iter([part])) for p in b.column(2).to_pylist()]
    read = shingles.ENTRIES.read(sent)
    assert set(read["n"]) == {396} and len(set(read["name"])) == 200 and len(read["n"]) == 200 * (396 - 317 + 1)
    assert sum(map(len, sent)) <= 19 * len(read["n"])


def test_op5_joins_only_texts_that_may_link(spark):
    """at size the join of candidates to their texts dealt out the text of every row."""
    rows = spark.createDataFrame([(k,) for k in range(0, 2000, 100)], "row long")
    asked = spark.sparkContext.broadcast(shingles.marked_rows(rows))
    kept = {r.id for r in spark.range(100_000).where(shingles.among(asked)("id")).collect()}
    assert kept >= set(range(0, 2000, 100)) and len(kept) < 100


def test_op5_candidates_share_more_than_one_shingle(spark):
    """F1, F2: unlike sets that share one rare shingle by chance became one component as tables grew, 9,103 large texts at 2.5 GB,
    and each text went to many blocks."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(40):  # each shares one shingle with the one before and the one after
        words = [f"w{i}_{k}" for k in range(396)]
        words[:5], words[10:15] = [f"link{i}_{k}" for k in range(5)], [f"link{i + 1}_{k}" for k in range(5)]
        rows.append((i, " ".join(words)))
    for i in range(40, 60):  # near copies, of all sizes that link
        words = rows[i - 40][1].split()[: int(rng.integers(330, 397))]
        for at in rng.choice(len(words), int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    part = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    counts = type("Counts", (), {"value": np.zeros(1 << shingles.COUNTER_BITS, np.uint32)})
    s = shingles.Sets([t.encode() for _, t in rows])
    np.add.at(counts.value, (s.shingles >> np.uint64(64 - shingles.COUNTER_BITS)).astype(np.int64), 1)

    def by_bucket(batches):
        return iter([pa.Table.from_batches(list(batches)).sort_by("key").combine_chunks().to_batches()[0]])

    entries = by_bucket(shingles.prefix_entries(counts, 64)(iter([part])))
    edges = list(shingles.candidate_edges(by_bucket(shingles.candidate_pairs(4)(entries))))
    ends = [pa.Table.from_batches(edges)[c].combine_chunks() for c in ("u", "v")]
    nodes, roots = components.rooted(*(components.numbers(x) for x in ends))
    sizes = np.unique(roots[:, 1], return_counts=True)[1]
    linked = brute_components(rows)
    assert sizes.max() == 2 and len(sizes) >= sum(c > 1 for c in Counter(r[2] for r in linked).values()) > 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in shingles.similar(df).collect()) == sorted(linked)


@pytest.mark.parametrize("size", range(1, 130, 7))
def test_op5_linked_sets_share_enough_in_their_prefixes(size):
    """what candidates are asked for holds for all sets that link, whatever the order of the shingles."""
    rng = np.random.default_rng(size)
    for other in range(size, size * 5 // 4 + 1):
        both = int(shingles.overlap_needed(size, other))
        for _ in range(20):
            order = rng.permutation(size + other - both)
            a, b = np.sort(order[:size]), np.sort(order[size - both :])
            need = shingles.shared_needed(np.int64(size), np.int64(other))
            shared = np.intersect1d(a, b)
            before = [(np.searchsorted(x, shared) < shingles.prefix_length(len(x))) & (len(x) - np.searchsorted(x, shared) > both - need) for x in (a, b)]
            assert len(shared) == both and 1 <= need <= (before[0] & before[1]).sum()


def test_op6_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op6_licenses"](spark, sf).select("doc_id", "sentence_ids", "licenses", "n_unmatched").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op6_licenses"]).fetchall())


def test_op6_rules(spark, odd, none):
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'
    texts = [header, "This program is free software", "Released under the MIT License.\nReleased under the MIT License.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (list(r.licenses), list(r.unmatched)) for r in licenses.scan(df).collect()}
    assert got == {0: (["Apache-2.0"], []), 1: ([], ["GplFree"]), 2: (["MIT"], []), 3: ([], []), 4: ([], [])}
    assert sorted(r.doc_id for r in licenses.scan(odd).where("array_contains(licenses, 'CC-BY-NC-4.0')").collect()) == [8, 9]
    assert licenses.scan(none).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// ", ";; "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_op6_wrapped_texts(spark, prefix, end):
    import textwrap

    wants = [(MIT, "MIT", ["MitGrant", "MitNotice", "MitAsIs"]), (BSD, "BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]), (GPL.format(3), "GPL-3.0-or-later", ["GplFree", "Gpl3Later"]), (GPL.format(2), "GPL-2.0-or-later", ["GplFree", "Gpl2Later"])]
    texts = []
    for width in (20, 72, 80):
        for text, *_ in wants:
            lines = [x for line in text.split("\n") for x in textwrap.wrap(line, width) or [""]]
            texts.append(end.join((prefix + x).rstrip() for x in ["The name of it", "Copyright (c) 2020 A. Name", *lines, "", "More words."]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r.doc_id: (list(r.licenses), list(r.sentence_ids)) for r in licenses.scan(df).collect()}
    assert got == {k: ([wants[k % 4][1]], wants[k % 4][2]) for k in range(len(texts))}


ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."""
MIT_END = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE.'
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
WHOLE = {
    "MIT": f"MIT License\n\nCopyright (c) 2024 A. Name\n\n{MIT} {MIT_END}",
    "ISC": f"ISC License\n\nCopyright (c) 2024, A. Name\n\n{ISC}",
    "BSD-2-Clause": f"Copyright (c) 2024, A. Name\nAll rights reserved.\n\n{BSD}\n\n{BSD_END}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\n{BSD}\n{BSD_NAMES}\n\n{BSD_END}",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n",
    "LGPL-2.1-or-later": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n",
    "GPL-3.0-or-later": "    This program is free  software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM",
    "EPL-2.0": "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS",
}
NOTICES = {
    "# SPDX-License-Identifier: MIT\nimport os": ["MIT"],
    "/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause) */\n#include <x.h>": ["BSD-2-Clause", "GPL-2.0-only"],
    "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n// more": ["Apache-2.0"],
    "SPDX-License-Identifier: GPL-2.0+\n": ["GPL-2.0-or-later"],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": ["MPL-2.0"],
    "no licence at all, but some software and conditions and a license": [],
}


def test_op6_names_whole_public_texts(spark):
    texts = [*WHOLE.values(), *NOTICES]
    wants = [[k] for k in WHOLE] + list(NOTICES.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted(r.licenses) for r in licenses.scan(df).collect()}
    assert got == dict(enumerate(wants)), [(texts[k][:40], got[k]) for k in got if got[k] != wants[k]]
    assert len({name for _, name in licenses.RULES}) >= 25 and all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())


def test_op6_sql_reads_wrapped_texts_alike(spark, tmp_path):
    import textwrap

    texts = [*WHOLE.values(), *NOTICES, None, "", "\r\n \r\n", *[("\r\n" if w % 2 else "\n").join(p + x for line in t.split("\n") for x in textwrap.wrap(line, w) or [""]) for w in (31, 60, 76) for p in ("", " * ", "// ") for t in WHOLE.values()]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op6_licenses"](spark, str(tmp_path)).select("doc_id", "sentence_ids", "licenses", "n_unmatched").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op6_licenses"]).fetchall())


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, sf).toPandas().set_index("doc_id")
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert set(got.index[got.held_out]) == {i for i in got.index if zlib.crc32(str(i).encode()) % 3 == 1}
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all() and len(got) == 10_000
    y, s = np.array([truth[i] for i in held]), got.score[held].to_numpy()
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.95


def test_op7_scores_equal_a_plain_forward_pass(spark, sf):
    """Word by word and filter by filter, from the model's numbers alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    some = docs.orderBy("doc_id").limit(40)
    got = {r.doc_id: r.score for r in toxicity.score(some, m).collect()}
    for r in some.collect():
        own = [w.strip(toxicity.EDGES) for w in (r.text or "").encode().split()]
        rows = toxicity.word_rows(own) if own else np.zeros((0, 5), int)
        vectors = [np.mean([m.rows[k].astype(float) for k in row], axis=0) if w else np.zeros(toxicity.DIM) for w, row in zip(own, rows, strict=True)] + [np.zeros(toxicity.DIM)] * 2
        pooled = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                at = [sum(vectors[i + o] @ m.filters[w][o][:, f] for o in range(w)) for i in range(len(own))]
                pooled.append(max(0.0, max(at) + m.bias[w][f]) if at else 0.0)
        logit = float(np.dot(pooled, m.weights)) + m.offset
        evidence = np.sum([m.languages[row[-1]] if w else np.zeros(m.languages.shape[1]) for w, row in zip(own, rows, strict=True)], axis=0) if own else np.zeros(m.languages.shape[1])
        want = 1 / (1 + np.exp(-(logit - m.thresholds[int(np.argmax(evidence))] + np.log(0.7 / 0.3))))
        assert got[r.doc_id] == pytest.approx(want, abs=1e-4)


def test_op7_sample_is_bounded(spark):
    rows = [(k % 10, f"text {k} " + "x" * (100 * k), "en") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    told = toxicity.training_rows(docs, labels, most_positive=3, most_bytes=5000, most_text=2500).collect()
    assert len({r.doc_id for r in told}) == len(told) and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and len(r.text) <= 2500 for r in told)
    assert all(sum(len(r.text) for r in told if r.toxic == y) <= 5000 for y in (0, 1)) and sum(r.toxic for r in told) <= 3


def test_op7_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (4, 1), (6, 0), (8, 0), (8, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert [r.score for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()] == [0.0] * len(ROWS)
    assert toxicity.score(none, model).collect() == []


def test_op8(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, sf).collect()}
    down = docs[::-1]
    for k, (i, t) in enumerate(down):
        half = len(t) // 2
        edited = t[: len(t) - half] + down[(k + 1) % len(down)][1][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by_text = defaultdict(set)
    for i, t in docs:
        by_text[t].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    near, far = (np.array([getattr(r, k) for r in got.values()]) for k in ("near_edited", "near_next"))
    assert near.mean() > 0.1 > far.mean() and (near > far).mean() > 0.7


def test_op8_odd_rows(odd, none):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == len(ROWS)
    assert len({tuple(r.parts) for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert fingerprints.fingerprints(none).collect() == []
    (only,) = fingerprints.fingerprints(odd.where("doc_id = 8")).collect()
    assert only.edited == only.text[: len(only.text) - len(only.text) // 2] + only.text[: len(only.text) // 2]


def test_op8_copies_and_common_words(spark):
    """Texts of many copies, and texts of words that all others hold, are told apart and found again when edited."""
    hot = [" ".join(f"{k}hot{i}" for i in range(60)) for k in "ab"]
    common = "and of the to in is it as".split()
    rare = [" ".join(common + [f"rare{(k + i) % 150}" for i in range(30)]) for k in range(150)]
    texts = [*rare[:75], *[hot[0]] * 200, *rare[75:], *[hot[1]] * 200, "and of the", "to in is it as", rare[0]]
    rows = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in rows.withColumn("near", fingerprints.likeness(rows.parts, rows.edited_parts)).collect()}
    parts = {texts[r.doc_id]: tuple(r.parts) for r in got.values()}
    assert len({parts[t] for t in (*hot, "and of the", "to in is it as")}) == 4 and all(any(x) for x in parts.values())
    edges = [got[k] for k in (75, 350)]  # the next documents of these have other texts
    assert all(texts[r.doc_id] in hot and r.edited != r.text and r.near > 0 for r in edges), [(r.doc_id, r.near) for r in edges]


def signed(x, bits):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def murmur(values, seed=42):
    """Spark's hash of an array of longs, restated."""
    h, m = seed, 0xFFFFFFFF
    for v in values:
        for word in (v & m, v >> 32 & m):
            word = word * 0xCC9E2D51 & m
            word = (word << 15 | word >> 17) & m
            h ^= word * 0x1B873593 & m
            h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & m
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
    return signed(h, 32)


@pytest.mark.parametrize(("most", "least"), [(0.02, 2), (0.3, 3), (0.05, 500)])
def test_op8_against_plain_i_match(spark, docs, most, least):
    """Term sets, frequencies of their buckets over distinct texts, band, subsets, hashes and likeness, one document after another."""
    import regex
    import xxhash

    rows = [*docs[:70], (500, docs[3][1]), (501, docs[3][1]), (502, ""), (503, None), (504, "!!"), (505, docs[3][1] + " zusatz")]
    terms = lambda t: {signed(xxhash.xxh64(w.encode(), seed=42).intdigest(), 64) for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())}
    texts = {t or "" for _, t in rows}
    bucket = lambda x: (x & (1 << 64) - 1) >> 64 - fingerprints.LEXICON_BITS
    df, count = (Counter(b for t in some for b in {bucket(x) for x in terms(t)}) for some in (texts, [t for _, t in rows]))
    band = {b for b in df if count[b] >= least and df[b] <= max(float(least), most * len(texts))}

    def parts(t):
        own = sorted(x for x in terms(t) if bucket(x) in band) or sorted(terms(t))
        some = [[x for x in own if (x >> 4 * seed) & (scale - 1) == 0] for scale in fingerprints.SCALES for seed in range(fingerprints.SEEDS)]
        return [murmur(x) if x else 0 for x in some]

    def near(a, b):
        n = fingerprints.SEEDS
        return 1.0 if a == b else max(sum(x == y != 0 for x, y in zip(a[k : k + n], b[k : k + n], strict=True)) / n for k in range(0, len(a), n))

    frame = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), most_share=most, least_count=least)
    got = {r.doc_id: r for r in frame.withColumn("ne", fingerprints.likeness(frame.parts, frame.edited_parts)).withColumn("nn", fingerprints.likeness(frame.parts, frame.next_parts)).collect()}
    down = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(down):
        t, after = t or "", down[(k + 1) % len(down)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].parts == parts(t) and got[i].edited_parts == parts(edited) and got[i].next_parts == parts(after), i
        assert (got[i].ne, got[i].nn) == (pytest.approx(near(parts(t), parts(edited))), pytest.approx(near(parts(t), parts(after))))


def test_op9_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op9_mixing"](spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op9_mixing"]).fetchall())


def test_op9_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ROWS)
    total = sum(r.size for r in rows)
    for r in rows:
        taken = sum(s.length for s in r.segments)
        assert taken <= 3 * r.size and r.target <= 3 * r.source_size and all(s.start + s.length <= r.size for s in r.segments)
    per = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in per) - total) < 1e-6 * total
    assert mixing.mix(none).collect() == []


def test_op9_small_sources_meet_their_targets(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(200)), "big") for k in range(50)] + [(100, "x y z", "tiny"), (101, "u v", "small"), (102, "t " * 7, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slot_bits=4).collect()
    taken = Counter()
    for r in got:
        assert all(0 <= s.start and s.length > 0 and s.start + s.length <= r.size for s in r.segments)
        taken[r.source_size, r.target] += sum(s.length for s in r.segments)
    assert len(taken) == 4 and all(n == round(target) for (_, target), n in taken.items()), taken


def check_pieces(pieces, texts, library):
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for i, t in texts:
        ids, at = library(t), 0
        for p in sorted(by_doc.pop(i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_op10(spark, sf, docs, library):
    assert check_pieces(QUERIES["op10_packing"](spark, sf).collect(), docs, library) == 0


def test_op10_odd_rows(odd, none, library):
    from pyspark.sql import functions as F

    rows = odd.where("doc_id is distinct from 7")
    pieces = packing.pack(rows).withColumn("ids_crc32", F.crc32("ids")).withColumn("length", F.col("length")).collect()
    assert check_pieces(pieces, [r[:2] for r in ROWS if r[0] != 7], library) == 0
    assert packing.pack(none).collect() == []


def test_sum_of_squares_takes_the_level_with_the_least_sum():
    rng = np.random.default_rng(0)
    packer = packing.SumOfSquares(32)
    for size in rng.integers(1, 32, 300).tolist():
        def squares(level, size=size):
            n = packer.counts.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n[:32] ** 2).sum())

        options = [0, *[k for k in range(1, 33 - size) if packer.counts[k]]]
        chosen = packer.level(size)
        assert chosen in options and squares(chosen) == min(map(squares, options))
        packer.place(("x",), size)


@pytest.mark.parametrize("few", [1 << 16, 3])
def test_components(spark, monkeypatch, few):
    """Chains, stars, cycles, repeated edges and loops; with `few` small, nodes of many edges are dealt in parts."""
    from docproof.llm import components

    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "HOT_KEYS", 10)
    rng = np.random.default_rng(2)
    order = rng.permutation(400)
    pairs = [(order[k], order[k + 1]) for k in range(99)]  # a chain in no order
    pairs += [(order[100], order[k]) for k in range(101, 180)] + [(order[179], order[k]) for k in range(180, 240)]
    pairs += [(order[240 + k], order[240 + (k + 1) % 30]) for k in range(30)] * 2 + [(5, 5)]
    pairs += [(order[a], order[b]) for a, b in rng.integers(280, 400, (60, 2))]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    name = lambda k: int(k).to_bytes(16, "big")
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "u binary, v binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components.components(edges).collect()}
    nodes = {int(x) for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: find(k) for k in nodes}
    assert components.components(edges.limit(0)).collect() == []


@pytest.mark.parametrize("at_once", [0, 1 << 18])
def test_few_edges_take_no_rounds(spark, monkeypatch, at_once):
    """The pipeline's driver memory: every round of a small edge list leaves stages and plans with the driver."""
    from docproof.llm import components as C

    monkeypatch.setattr(C, "AT_ONCE", at_once)
    runs = []
    monkeypatch.setattr(C, "_written", lambda edges, f=C._written: runs.append(1) or f(edges))
    b = lambda n: n.to_bytes(16, "big")
    edges = spark.createDataFrame([(b(k + 1), b(k)) for k in range(40) if k != 20] + [(b(99), b(99))], "u binary, v binary")
    got = {(int.from_bytes(r.node, "big"), int.from_bytes(r.root, "big")) for r in C.components(edges).collect()}
    assert got == {(k, 0 if k <= 20 else 21) for k in range(41)}
    assert len(runs) == 1 if at_once else len(runs) > 1
    assert C.components(edges.where("u = v")).collect() == []


def test_released_gives_back_what_the_jvm_freed_outside_its_heap(spark):
    """The pipeline's driver memory: glibc kept a third of a GB that the JVM had freed."""
    import re
    from pathlib import Path

    from docproof.llm._common import released

    jvm = spark._jvm
    pid = jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getName().split("@")[0]

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024

    for _ in range(2):
        jvm.System.gc()
    used = [jvm.java.util.zip.Deflater() for _ in range(1600)]
    for d in used[:-1]:  # the last one stands above all that was freed
        d.end()
    jvm.System.gc()
    before = held()
    released(spark)
    assert held() < before - 60
    used[-1].end()
