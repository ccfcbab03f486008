"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of hashed rows for the lower-cased word and its first 4 to 7 bytes.
Filters of widths 1, 2 and 3 slide over the whole text; each filter's largest response (max
pooling) feeds a logistic layer. Responses are tabulated per distinct word, so a position costs one
row of a table for each place in a filter.

Training takes a bounded sample of the labelled rows (`most_positive`, `most_negative` documents and
`most_bytes` of their texts, chosen by a hash of the id) and only rows with crc32(doc_id as text) % 3 != 1. Thresholds are
calibrated by language: the language is recognised from the words of the text itself (hashed word
frequencies per language, learnt from the same sample), the best threshold of each language is
taken on a part of the sample that the filters are not fitted to, and scores are shifted so that it
stands at 0.7. A score depends on the text alone.

Defined cases: null text is scored as the empty text; rows without a label, and null labels, teach
nothing; conflicting labels of one doc_id count as toxic; rows that share a doc_id teach once; without labelled rows of both classes every score is 0;
repeated rows are scored alike; further columns are ignored by `score` and kept by `attach`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docproof.llm._common import mixed, powers, small_batches, table, text_bytes, text_slices, tidy

#: A document is rejected from this score on.
THRESHOLD = 0.7
ROWS_BITS, DIM, FILTERS, WIDTHS = 17, 16, 12, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
EDGES = b".,;:!?\"'()[]{}<>*#$%&_-|"
#: Bounds of the training sample: documents of each class, text bytes of each class, and of one document. Training is one
#: task over this sample; longer documents are scored whole but teach nothing.
MOST_POSITIVE, MOST_NEGATIVE, MOST_BYTES, MOST_TEXT = 2000, 3000, 16 << 20, 256 << 10


def word_rows(words: list[bytes], most: int = 50_000) -> np.ndarray:
    """The embedding rows of each word: one for the word and one for each prefix."""
    if len(words) > most:
        return np.concatenate([word_rows(words[k : k + most]) for k in range(0, len(words), most)])
    low = [w.lower() for w in words]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    flat = np.frombuffer(b"".join(low), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    weights = powers(0x9E3779B97F4A7C15, int(lengths.max(initial=0)) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * weights[place], out=sums[1:])
    rows = [sums[starts + np.minimum(lengths, n)] - sums[starts] for n in (*PREFIXES, 1 << 40)]
    salted = np.stack([mixed(r + np.uint64(k)) for k, r in enumerate(rows)], 1)
    return (salted >> np.uint64(64 - ROWS_BITS)).astype(np.int32)


class Vocabulary(dict):
    """Numbers distinct words; 0 is the gap after a text's end."""

    def __init__(self):
        super().__init__({b"": 0})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each followed by gaps, and the word count of each text."""
        gap = [b""] * (max(WIDTHS) - 1)
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = [w.strip(EDGES) for w in text.split()]
            counts[k] = len(own)
            words += own
            words += gap
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), counts


@dataclass
class Model:
    rows: np.ndarray  # embedding rows
    filters: dict[int, np.ndarray]  # width -> [width, DIM, FILTERS]
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    offset: float
    languages: np.ndarray  # log frequency of hashed words by language, [rows, languages]
    thresholds: np.ndarray  # logits, by language

    def table(self, rows: np.ndarray) -> np.ndarray:
        """Of distinct words: responses at each place of each filter, then language evidence."""
        emb = self.rows[rows].mean(1)
        return np.concatenate([*(emb @ self.filters[w][o] for w in WIDTHS for o in range(w)), self.languages[rows[:, -1]]], 1)

    def logits(self, tabled: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw logit and recognised language of each text; tabled has a zero row 0."""
        pooled, evidence = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32), np.zeros((len(counts), self.languages.shape[1]), np.float32)
        gap = max(WIDTHS) - 1
        begins = np.cumsum(counts + gap) - (counts + gap)
        full = np.flatnonzero(counts)
        if len(full):
            n = len(numbers) - gap
            real = np.ones(len(numbers), bool)
            for g in range(gap):
                real[begins + counts + g] = False
            kept = np.flatnonzero(real[:n])
            firsts = np.cumsum(counts[full]) - counts[full]
            col = 0
            for k, w in enumerate(WIDTHS):
                act = tabled[numbers[kept], col : col + FILTERS]
                for o in range(1, w):
                    act = act + tabled[numbers[kept + o], col + o * FILTERS : col + (o + 1) * FILTERS]
                col += w * FILTERS
                pooled[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(act, firsts, axis=0) + self.bias[w], 0)
            evidence[full] = np.add.reduceat(tabled[numbers[kept], col:], firsts, axis=0)
        return pooled @ self.weights + self.offset, evidence.argmax(1) if self.languages.shape[1] else np.zeros(len(counts), int)

    def scores(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        shifted = logits.astype(np.float64) - self.thresholds[language] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(shifted, -60, 60)))


def fit_numpy(texts: list[bytes], labels: np.ndarray, langs: list, seen: int = 16_000, seed: int = 7) -> Model | None:
    """Passes over the texts until about `seen` have been looked at, 6 to 40 times each."""
    if len(set(labels.tolist())) < 2:
        return None
    epochs = min(40, max(6, seen // len(texts)))
    rng = np.random.default_rng(seed)
    vocabulary = Vocabulary()
    numbered = [vocabulary.number([t]) for t in texts]
    feats = word_rows([b"", *vocabulary.new])
    names = sorted({str(x) for x in langs})
    spoken = np.array([names.index(str(x)) for x in langs])
    held = rng.random(len(texts)) < 0.2

    frequency = np.full((1 << ROWS_BITS, len(names)), 0.1)
    for k in np.flatnonzero(~held):
        ids, n = numbered[k]
        np.add.at(frequency[:, spoken[k]], feats[ids[: n[0]], -1], 1)
    evidence = np.log(frequency / frequency.sum(0))
    evidence = (evidence - evidence.mean(1, keepdims=True)).astype(np.float32)

    m = Model(
        rows=rng.normal(0, 0.3, (1 << ROWS_BITS, DIM)).astype(np.float32),
        filters={w: rng.normal(0, 0.5 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        bias={w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        weights=rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        offset=0.0, languages=evidence, thresholds=np.zeros(len(names)),
    )
    order = np.flatnonzero(~held)
    scale = {1: 0.5 / max(1, labels[order].sum()), 0: 0.5 / max(1, (1 - labels[order]).sum())}
    weight = np.array([scale[int(y)] for y in labels]) * len(order)
    past: dict = {}

    def step(name, value, grad, rate=0.08, at=None):
        """Adagrad."""
        sums = past.setdefault(name, np.zeros_like(value, dtype=np.float32))
        if at is None:
            sums += grad * grad
            value -= rate * grad / (np.sqrt(sums) + 1e-6)
        else:
            sums[at] += grad * grad
            value[at] -= rate * grad / (np.sqrt(sums[at]) + 1e-6)

    size = 32
    for _ in range(epochs):
        rng.shuffle(order)
        for first in range(0, len(order), size):
            batch = order[first : first + size]
            used, inverse = np.unique(np.concatenate([numbered[k][0] for k in batch] or [np.zeros(0, int)]), return_inverse=True)
            emb = m.rows[feats[used]].mean(1)
            emb[used == 0] = 0
            responses = {w: [emb @ m.filters[w][o] for o in range(w)] for w in WIDTHS}
            pooled, best, at = np.zeros((len(batch), len(m.weights)), np.float32), [], 0
            for d, k in enumerate(batch):
                n = int(numbered[k][1][0])
                ids, at = inverse[at : at + n + max(WIDTHS) - 1], at + n + max(WIDTHS) - 1
                places = {}
                for j, w in enumerate(WIDTHS):
                    if not n:
                        continue
                    act = responses[w][0][ids[:n]]
                    for o in range(1, w):
                        act = act + responses[w][o][ids[o : n + o]]
                    p = act.argmax(0)
                    pooled[d, j * FILTERS : (j + 1) * FILTERS] = np.maximum(act[p, np.arange(FILTERS)] + m.bias[w], 0)
                    places[w] = [ids[p + o] for o in range(w)]
                best.append(places)
            z = pooled @ m.weights + m.offset
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
            back = error[:, None] * m.weights * (pooled > 0)
            d_emb = np.zeros_like(emb)
            whose, moved = [], []
            for j, w in enumerate(WIDTHS):
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                rows = [d for d, places in enumerate(best) if w in places]
                d_filter = np.zeros_like(m.filters[w])
                for o in range(w if rows else 0):
                    who = np.stack([best[d][w][o] for d in rows])
                    d_filter[o] = np.einsum("dfe,df->ef", emb[who], part[rows])
                    whose.append(who.reshape(-1))
                    moved.append((part[rows][:, :, None] * m.filters[w][o].T).reshape(-1, DIM))
                step(("f", w), m.filters[w], d_filter)
                step(("b", w), m.bias[w], part.sum(0))
            if whose:
                np.add.at(d_emb, np.concatenate(whose), np.concatenate(moved))
            step("w", m.weights, pooled.T @ error + 1e-4 * m.weights)
            m.offset -= 0.05 * float(error.sum())
            touched = np.flatnonzero(np.abs(d_emb).sum(1) > 0)
            touched = touched[used[touched] != 0]
            if len(touched):
                where, back_to = np.unique(feats[used[touched]], return_inverse=True)
                grad = np.zeros((len(where), DIM), np.float32)
                np.add.at(grad, back_to.reshape(-1), np.repeat(d_emb[touched] / feats.shape[1], feats.shape[1], 0))
                step("rows", m.rows, grad, 0.15, where)
    calibrate(m, numbered, feats, labels, held, len(names))
    return m


def calibrate(m: Model, numbered: list, feats: np.ndarray, labels: np.ndarray, held: np.ndarray, languages: int) -> None:
    """The threshold of each language with the fewest weighted errors on the rows held back."""
    z, lang = np.zeros(len(numbered)), np.zeros(len(numbered), int)
    for first in range(0, len(numbered), 50):  # a table of all words at once would be large
        part = numbered[first : first + 50]
        used, inverse = np.unique(np.concatenate([np.zeros(1, np.int64), *(ids for ids, _ in part)]), return_inverse=True)
        tabled = m.table(feats[used])
        tabled[0] = 0  # the gap
        z[first : first + 50], lang[first : first + 50] = m.logits(tabled, inverse[1:], np.concatenate([n for _, n in part]))

    def best(rows: np.ndarray) -> float:
        v, y = z[rows], labels[rows]
        order = np.argsort(v)
        v, y = v[order], y[order]
        # errors when all from place k on are called toxic; clean documents are nine of ten in a corpus
        wrong = np.concatenate([[0], np.cumsum(y == 1)]) + 2.0 * np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
        k = np.flatnonzero(wrong == wrong.min())
        low, high = k[0], k[-1]
        edge = lambda i: v[i - 1] + 1.0 if i == len(v) else v[i] - 1.0 if i == 0 else (v[i - 1] + v[i]) / 2
        return float((edge(low) + edge(high)) / 2)

    overall = best(held) if len(set(labels[held].tolist())) > 1 else 0.0
    for k in range(languages):
        rows = held & (lang == k)
        clean = z[(lang == k) & (labels == 0)]
        if (labels[rows] == 1).sum() >= 8 and (labels[rows] == 0).sum() >= 8:
            m.thresholds[k] = best(rows)
        else:  # too few toxic rows to weigh: just above what clean texts of the language score
            m.thresholds[k] = min(overall, max(0.5, float(np.quantile(clean, 0.995)) + 0.7)) if len(clean) >= 30 else overall


def training_rows(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_negative: int = MOST_NEGATIVE, most_bytes: int = MOST_BYTES, most_text: int = MOST_TEXT) -> DataFrame:
    """The bounded training sample: doc_id, text, lang, toxic. Ids whose crc32 modulo 3 is 1 stay out; of rows that share an
    id the one with the smallest hash teaches."""
    told = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = told.where(~held_out())
    order = F.xxhash64("doc_id")
    picked = told.where("toxic = 1").orderBy(order, "doc_id").limit(most_positive).unionByName(told.where("toxic = 0").orderBy(order, "doc_id").limit(most_negative))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    rows = rows.where(F.octet_length("text") <= most_text).join(F.broadcast(picked), "doc_id")
    own = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text", "lang"), "text", "lang")).alias("own")
    upto = F.sum(F.octet_length("own.text")).over(W.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.groupBy("doc_id", "toxic").agg(own).withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "own.text", "own.lang", "toxic")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model as bytes, from all rows of the bounded sample."""
    rows = []
    for b in batches:
        rows += zip(*(b.column(k).to_pylist() for k in (0, 3, 2)), text_bytes(b.column(1)), strict=True)
    if rows:
        _, toxic, langs, texts = zip(*sorted(rows, key=lambda r: r[0]), strict=True)
        rows.clear()
        yield pa.record_batch([pa.array([pickle.dumps(fit_numpy(list(texts), np.array(toxic), list(langs)))], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model | None:
    """Trains in one task over the bounded sample; only the model, of fixed size, comes to the driver. A lost executor's task
    is run again and gives the same model: the sample is ordered by id."""
    small_batches(docs.sparkSession)
    found = training_rows(docs, labels, **bounds).repartition(1).mapInArrow(tidy(_trainer), "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def _scorer(model, position: int, most_words: int = 100_000):
    """Appends the score; the distinct words' tables are kept between batches up to a bound."""
    kept: dict = {}

    def scored(texts: list[bytes]) -> np.ndarray:
        m = model.value
        if m is None:
            return np.zeros(len(texts))
        if not kept or len(kept["vocabulary"]) > most_words:
            kept["vocabulary"], kept["table"] = Vocabulary(), np.zeros((1, sum(WIDTHS) * FILTERS + m.languages.shape[1]), np.float32)
        vocabulary = kept["vocabulary"]
        numbers, counts = vocabulary.number(texts)
        new, vocabulary.new = vocabulary.new, []
        if new:
            need = len(vocabulary)
            if need > len(kept["table"]):
                grown = np.zeros((max(need, 2 * len(kept["table"])), kept["table"].shape[1]), np.float32)
                grown[: need - len(new)] = kept["table"][: need - len(new)]
                kept["table"] = grown
            kept["table"][need - len(new) : need] = m.table(word_rows(new))
        return m.scores(*m.logits(kept["table"], numbers, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[position], 1 << 20):
                scores = scored(text_bytes(part.column(position)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "__score"])
        kept.clear()  # the worker process goes on to other tasks

    return run


def attach(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs and `__score`."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    return docs.mapInArrow(tidy(_scorer(spark.sparkContext.broadcast(model), docs.columns.index("text"))), schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every document."""
    return attach(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", F.col("__score").alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
