"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence is toxic with probability
``sigmoid(bias + sum of the weights of its features)``; the document is toxic if any
sentence is: ``1 - product(1 - p)``, the noisy-or.  Only documents carry labels, so the
gradient of the document's likelihood spreads over its sentences, and the fitted sentence
scores locate what is offensive.

Features of a sentence are its lower-cased words and the beginnings of its words (4 to 8
characters), once for each different word, kept where they occur far more often in toxic documents than chance allows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import arrow_map, materialize, prepare

#: Labelled documents that the model is fitted on, at most (the smallest by hash of the id), and
#: the characters of their texts together; documents beyond either bound are scored, not fitted on.
MAX_TRAIN, MAX_TRAIN_CHARS = 20_000, 200_000_000
#: Features at most; they are broadcast with their weights.
MAX_FEATURES = 4096
#: A feature must occur in so many training documents, so many standard deviations too often in toxic ones.
MIN_DOCS, MIN_Z = 5, 5.0
#: Every fifth labelled document is held out.
FOLDS = 5
#: Counts that a task holds before it hands them on.
MAX_COUNTS = 400_000
#: Lengths of word beginnings; the word must go on after them.
PREFIXES = (4, 5, 6, 7, 8)

_WORDS = re.compile(r"\w+")
_SENTENCES = re.compile(r"[^.!?\n]+")


@dataclass
class Model:
    """``weights``: of words as they are, of word beginnings with a trailing ``*``."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    base_rate: float = 0.0

    def sentence(self, words: set[str]) -> float:
        total = self.bias
        for f in features(words):
            total += self.weights.get(f, 0.0)
        return total

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and (start, end, probability) of the sentences from one half."""
        lower = lowered(text)
        known = {w for w in set(_WORDS.findall(lower)) if w in self.weights or any(len(w) > k and w[:k] + "*" in self.weights for k in PREFIXES)}
        none = -np.logaddexp(0, self.bias)  # log(1 - p) of a sentence without features
        log_clean, spans = 0.0, []
        if not known:
            return float(-np.expm1(none * sum(1 for m in _SENTENCES.finditer(lower) if not m[0].isspace()))), spans
        for m in _SENTENCES.finditer(lower):
            if m[0].isspace():
                continue
            own = known.intersection(_WORDS.findall(m[0]))
            if not own:
                log_clean += none
                continue
            z = self.sentence(own)
            log_clean -= np.logaddexp(0, z)
            if z >= 0:
                spans.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(log_clean)), spans


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length: offsets stay true."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower()[0] for c in text)


def features(words: set[str]) -> list[str]:
    """Each different word, and its beginnings; words with one beginning count one by one."""
    return [*words, *(w[:k] + "*" for w in words for k in PREFIXES if len(w) > k)]


#: Share of the bound on training characters from which a text is long.
LONG_SHARE = 0.02


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """_id, _text, _label, stored: one row for each of at most ``max_train`` labelled ids that are not held out.

    Null ids and labels are left out; of conflicting labels of an id the higher counts, of
    its texts the last in binary order, null as empty.  Documents of which the
    characters up to them exceed ``max_chars`` are left out; the order is that of the hash, but
    texts of more than ``LONG_SHARE`` of that bound come last, so a long text takes no other's place.
    Empty tables give no rows; other columns are ignored.
    """
    key = F.col(f"`{id_col}`").cast("long")
    known = labels.select(key.alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    # Bounded by max_train rows of 12 bytes, hence the broadcast.
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = docs.select(key.alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")).join(F.broadcast(some), "_id")
    rows = materialize(texts.groupBy("_id").agg(F.max("_text").alias("_text"), F.max("_label").alias("_label")), "training")
    total = F.sum("_n").over(Window.orderBy(F.col("_n") > max_chars * LONG_SHARE, F.xxhash64("_id"), "_id"))  # over max_train rows at most
    over = rows.select("_id", F.char_length("_text").cast("long").alias("_n")).select("_id", total.alias("_n")).where(F.col("_n") > max_chars)
    return rows.join(F.broadcast(over), "_id", "left_anti")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, toxic = Counter(), Counter()

    def out() -> pa.RecordBatch:
        keys = list(docs)
        return pa.RecordBatch.from_pydict({"feature": keys, "n": [docs[k] for k in keys], "toxic": [toxic[k] for k in keys]}, pa.schema([("feature", pa.string()), ("n", pa.int64()), ("toxic", pa.int64())]))

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = set(features(set(_WORDS.findall(lowered(text)))))
            docs.update(own)
            if label:
                toxic.update(own)
            if len(docs) > MAX_COUNTS:
                yield out()
                docs.clear()
                toxic.clear()
    yield out()


def _bags(names: list[str]):
    """Training documents as bags: sentences in all, and the features of those that have some."""
    index = {x: i for i, x in enumerate(names)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sentences = [], []
            for text in batch.column(0).to_pylist():
                parts = [m for m in _SENTENCES.findall(lowered(text)) if not m.isspace()]
                hits = (sorted(index[f] for f in features(set(_WORDS.findall(p))) if f in index) for p in parts)
                sentences.append([h for h in hits if h])
                n.append(len(parts))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int32()), pa.array(sentences, pa.list_(pa.list_(pa.int32())))], ["label", "n", "sentences"])

    return task


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows.

    The sample is stored once and read three times.  The driver gets at most
    ``MAX_FEATURES`` features and ``max_train`` bags of their numbers.  Without labels, or with labels of one kind, the model scores 0 everywhere.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_train, max_chars).select("_text", "_label")
    totals = rows.agg(F.count("*").alias("n"), F.sum(F.col("_label").cast("long")).alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not 0 < toxic < n:
        return Model(-50.0)
    p = toxic / n
    counts = arrow_map(rows, _count_features, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    chosen = counts.where(F.col("n") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    names = [r["feature"] for r in chosen]
    bags = arrow_map(rows, _bags(names), "label int, n int, sentences array<array<int>>").collect()
    return _fit(names, [(int(r["label"]), r["n"], r["sentences"]) for r in bags], p)


def _fit(names: list[str], bags: list[tuple[int, int, list[list[int]]]], base_rate: float, steps: int = 400, l2: float = 1e-5) -> Model:
    """Adam on the noisy-or likelihood; the order of the bags does not matter."""
    bags = sorted(bags)
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] - len(b[2]) for b in bags], float)
    sentence_doc = np.array([d for d, b in enumerate(bags) for _ in b[2]], dtype=np.int64)
    flat = [(s, f) for s, own in enumerate(x for b in bags for x in b[2]) for f in own]
    rows, cols = (np.array(flat, dtype=np.int64).reshape(-1, 2)).T
    n_s, k = len(sentence_doc), len(names)
    theta = np.concatenate([np.zeros(k), [-4.0]])
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        w, b = theta[:k], theta[k]
        z = b + np.bincount(rows, w[cols], n_s)
        p_s, p_0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        log_clean = -np.bincount(sentence_doc, np.logaddexp(0, z), len(bags)) - plain * np.logaddexp(0, b)
        clean = np.exp(log_clean)
        # d(-log likelihood)/d(log_clean): y=0: -1; y=1: clean/(1-clean)
        g_doc = np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0) / len(bags)
        g_s = -p_s * g_doc[sentence_doc]
        grad = np.concatenate([np.bincount(cols, g_s[rows], k) + l2 * w, [-(plain * p_0 * g_doc).sum() + g_s.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[k]), {x: float(a) for x, a in zip(names, theta[:k], strict=True)}, base_rate)


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])))])


def toxicity(text: Column, model: Model) -> Column:
    """Struct of the document score and its offending sentences; null and empty texts score 0."""

    @F.arrow_udf(SCORED)
    def score(texts: pa.Array) -> pa.Array:
        rows = [model.score(t or "") for t in texts.to_pylist()]
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in r[1]] for r in rows], pa.list_(span))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), spans], ["score", "spans"])

    return score(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of ``docs``.

    Only the text goes into a score.  Null and empty texts score 0; a null id is never held
    out; repeated rows each get a row; of conflicting labels of one id the higher counts;
    labels of unknown or null ids and null labels are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col, max_train)
    prepare(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    out = docs.select(key.alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), toxicity(F.col(f"`{text_col}`"), model).alias("_t"))
    return out.select("doc_id", "held_out", F.col("_t.score").alias("score"), (F.col("_t.score") >= 0.5).cast("int").alias("predicted"), F.col("_t.spans").alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the fitted model does not call toxic.

    Null and empty texts stay; repeated rows stay or go together; extra columns, clashing
    ones too, come through; without labels, or for an empty table, nothing goes.
    """
    model = fit(docs, labels, text_col=text_col)
    prepare(docs.sparkSession)
    return docs.where(toxicity(F.col(f"`{text_col}`"), model)["score"] < 0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
