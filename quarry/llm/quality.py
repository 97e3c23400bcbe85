"""Document quality by co-training two views.

View one is the text itself: shares of kinds of characters, repetition of words, the make-up
of lines.  View two is what is known about the document without reading it: language,
source, size and layout.  Each view has its own logistic classifier.  In each round, each
classifier scores all unlabelled documents and labels those that it is surest about, as many
of either kind as the labels suggest, and hands them to the *other* one.  Then each view is
calibrated on labelled documents that took no part, and a logistic model over the two calibrated log-odds scores every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import KeyFilter, arrow_map, materialize, prepare
from quarry.llm.words import blocks, hash_words, mix

#: Labelled documents that the models are fitted on, at most; the smallest by hash of the id.
#: The driver holds their features, some 100 numbers each.
MAX_LABELLED = 20_000
ROUNDS = 4
#: Documents that a view hands over in a round, as a share of the labelled ones, and how sure it must be.
HANDED, SURE = 0.1, 0.95
#: Every fifth labelled document is held out; of the others every fourth calibrates.
FOLDS = 5
META_BUCKETS = 64

_KINDS = np.zeros(256, dtype=np.int64)  # others
_KINDS[65:91] = 1
_KINDS[97:123] = 2
_KINDS[128:] = 2
_KINDS[48:58] = 3
_KINDS[[32, 9]] = 4
_KINDS[10] = 5
_KINDS[[44, 46, 58, 59, 39, 34, 45, 63]] = 6
_KINDS[[35, 36, 37, 38, 42, 64, 94, 126, 61, 43]] = 7
_KINDS[[124, 60, 62, 91, 93, 123, 125, 92, 47, 95]] = 8
_KINDS[33] = 9
N_KINDS = 10
TEXT_FEATURES = N_KINDS + 6
META_FEATURES = 4 + META_BUCKETS


def text_features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), TEXT_FEATURES), dtype=np.float32)
    for at, block in blocks(texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in block]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(block)
        size = np.array([len(r) for r in raw])
        doc = np.repeat(np.arange(n), size)
        kinds = np.bincount(doc * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
        words = hash_words(block)
        count = words.counts
        of = np.repeat(np.arange(n), count)
        order = np.lexsort((words.hashes, of))
        h, d = words.hashes[order], of[order]
        distinct = np.bincount(d[np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])] if len(h) else d, minlength=n)
        again = np.bincount(of[1:][(words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(of) else np.zeros(n)
        some = np.maximum(count, 1)
        x = out[at : at + n]
        x[:, :N_KINDS] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
        x[:, N_KINDS] = distinct / some
        x[:, N_KINDS + 1] = again / some
        x[:, N_KINDS + 2] = np.minimum((size - kinds[:, 4]) / some, 40) / 10
        x[:, N_KINDS + 3] = np.log1p(count) / 10
        x[:, N_KINDS + 4] = kinds[:, 1] / np.maximum(1, kinds[:, 1] + kinds[:, 2])
        x[:, N_KINDS + 5] = distinct / np.sqrt(some) / 10
    return out


def meta_features(lang: list, source: list, n_chars: list, n_lines: list) -> np.ndarray:
    out = np.zeros((len(lang), META_FEATURES), dtype=np.float32)
    chars = np.array([max(0, x or 0) for x in n_chars], dtype=float)
    lines = np.array([max(1, x or 1) for x in n_lines], dtype=float)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.log1p(chars) / 10, np.log(lines) / 10, np.log1p(chars / lines) / 10, chars < 300
    for values, salt in ((lang, 1), (source, 2)):
        ids = {v: 4 + int(mix(np.array([_text_hash(v) + salt], dtype=np.uint64))[0] % np.uint64(META_BUCKETS)) for v in set(values)}
        out[np.arange(len(values)), [ids[v] for v in values]] += 1.0
    return out


def _text_hash(v) -> int:
    import zlib

    return zlib.crc32(repr(v).encode("utf-8", "surrogatepass"))


@dataclass
class Logistic:
    """Logistic regression on standardized features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, balanced: bool = False, steps: int = 30) -> Logistic:
    """Newton's method; the classes weigh the same if ``balanced``."""
    x = x.astype(float)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    sample = (np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) if balanced else np.ones(len(y))) / len(y)
    theta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (sample * (p - y)) + penalty * theta
        hess = (z * (sample * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, theta[:-1], float(theta[-1]))


@dataclass
class Model:
    views: list[Logistic]
    calibration: list[Logistic]
    top: Logistic

    def score(self, x: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        own = [c.logit(v.logit(f)[:, None]) for v, c, f in zip(self.views, self.calibration, x, strict=True)]
        both = self.top.logit(np.clip(np.stack(own, 1), -12, 12))
        return _sigmoid(both), [_sigmoid(o) for o in own]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _constant(width: int, p: float) -> Logistic:
    return Logistic(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(p / (1 - p))))


#: Of the views, numbers of documents wanted by kind, and ids that are taken: (view, kind, ids, features of both views).
Hand = Callable[[list[Logistic], dict[float, int], set[int]], list[tuple[int, float, list[int], list[np.ndarray]]]]


def co_train(x: list[np.ndarray], y: np.ndarray, hand: Hand, rounds: int = ROUNDS) -> Model:
    """Fit both views on labelled rows ``x, y`` with the unlabelled ones that ``hand`` gives."""
    if len(y) < 8 or not 0 < y.mean() < 1:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        widths = [TEXT_FEATURES, META_FEATURES]
        return Model([_constant(w, p) for w in widths], [Logistic(np.zeros(1), np.ones(1), np.ones(1), 0.0)] * 2, Logistic(np.zeros(2), np.ones(2), np.full(2, 0.5), 0.0))
    kept = np.arange(len(y)) % 4 == 3  # calibrates
    if not 0 < y[kept].mean() < 1 or not 0 < y[~kept].mean() < 1:
        kept = np.zeros(len(y), dtype=bool)
    cal = kept if kept.any() else np.ones(len(y), dtype=bool)
    rows = [[f[~kept]] for f in x]
    labels = [[y[~kept]] for _ in x]
    taken: set[int] = set()
    wanted = {kind: int(HANDED * len(y) * part) for kind, part in ((1.0, y.mean()), (0.0, 1 - y.mean()))}
    views = [fit_logistic(np.vstack(r), np.concatenate(v)) for r, v in zip(rows, labels, strict=True)]
    for _ in range(rounds):
        given = hand(views, wanted, taken)
        if not any(ids for _, _, ids, _ in given):
            break
        for k, kind, ids, features in given:
            other = 1 - k
            taken.update(ids)
            rows[other].append(features[other])
            labels[other].append(np.full(len(ids), kind))
        views = [fit_logistic(np.vstack(r), np.concatenate(v)) for r, v in zip(rows, labels, strict=True)]
    own = [v.logit(f[cal])[:, None] for v, f in zip(views, x, strict=True)]
    calibration = [fit_logistic(o, y[cal]) for o in own]
    both = np.clip(np.stack([c.logit(o) for c, o in zip(calibration, own, strict=True)], 1), -12, 12)
    return Model(views, calibration, fit_logistic(both, y[cal]))


def _columns(docs: DataFrame, cols: dict[str, str]) -> list[Column]:
    """id, text, lang, source, n_chars, n_lines; columns that are missing are null."""
    get = lambda k, kind: F.col(f"`{cols[k]}`").cast(kind) if cols[k] in docs.columns else F.lit(None).cast(kind)
    text = F.coalesce(get("text", "string"), F.lit(""))
    return [get("id", "long").alias("id"), text.alias("text"), get("lang", "string").alias("lang"), get("source", "string").alias("source"), F.char_length(text).alias("n_chars"), (F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).alias("n_lines")]


def _lists(x: np.ndarray) -> pa.ListArray:
    width = x.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), pa.array(x.ravel()))


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text view takes the place of the text."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(text_features(batch.column(1).to_pylist())), *batch.columns[2:]], ["id", "x", *batch.schema.names[2:]])


#: Groups in which the surest documents of all tasks are ranked first.
SALTS = 32
META = "lang string, source string, n_chars int, n_lines int"
PICKED = "view int, kind double, sure double, place long, id long, both array<float>"


def _both(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of the rows of a table of text views."""
    return [batch.column(1).flatten().to_numpy().reshape(-1, TEXT_FEATURES), meta_features(*(c.to_pylist() for c in batch.columns[2:6]))]


def _surest(views: list[Logistic], wanted: dict[float, int], taken: set[int]):
    """Of a task's documents, those that each view is surest about; ties go by a hash of the id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, float], tuple[np.ndarray, ...]] = {}
        for batch in batches:
            x, ids = _both(batch), batch.column(0).to_numpy()
            free = ~np.isin(ids, list(taken))
            place = (mix(ids.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
            for view in (0, 1):
                p = _sigmoid(views[view].logit(x[view]))
                for kind, n in wanted.items():
                    sure = p if kind else 1 - p
                    good = np.flatnonzero(free & (sure >= SURE))
                    own = (sure[good], place[good], ids[good], np.hstack(x)[good])
                    if (view, kind) in best:
                        own = tuple(np.concatenate(c) for c in zip(best[view, kind], own, strict=True))
                    top = np.lexsort((own[2], own[1], -own[0]))[:n]
                    best[view, kind] = tuple(c[top] for c in own)
        for (view, kind), (sure, place, ids, both) in best.items():
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([view] * n, pa.int32()), pa.array([kind] * n, pa.float64()), pa.array(sure, pa.float64()), pa.array(place, pa.int64()), pa.array(ids, pa.int64()), _lists(both.astype(np.float32))], [c.split()[0] for c in PICKED.split(", ")])

    return task


def unlabelled(pool: DataFrame) -> Hand:
    """Hands over documents of a stored table of text views: id, x and the columns of ``META``.

    A round is one pass over the table.  Each task hands on its surest documents.  The surest of each of ``SALTS`` groups
    are found first, and of those, a bounded number however many tasks there are, the surest of all, which
    go to the driver, so many as are wanted.
    """

    def hand(views: list[Logistic], wanted: dict[float, int], taken: set[int]) -> list[tuple[int, float, list[int], list[np.ndarray]]]:
        order = (F.desc("sure"), "place", "id")
        some, top = Window.partitionBy("view", "kind", "salt").orderBy(*order), Window.partitionBy("view", "kind").orderBy(*order)
        most = F.when(F.col("kind") > 0, wanted[1.0]).otherwise(wanted[0.0])
        picked = arrow_map(pool, _surest(views, wanted, taken), PICKED).dropDuplicates(["view", "kind", "id"])
        picked = picked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= max(wanted.values()))
        rows = picked.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max(wanted.values())).where(F.col("rank") <= most).collect()
        out, gone = [], set()
        for view in (0, 1):
            for kind in wanted:
                own = [r for r in rows if (r["view"], r["kind"]) == (view, kind) and r["id"] not in gone]
                own.sort(key=lambda r: r["rank"])
                gone.update(r["id"] for r in own)
                both = np.array([r["both"] for r in own], dtype=float).reshape(-1, TEXT_FEATURES + META_FEATURES)
                out.append((view, kind, [r["id"] for r in own], [both[:, :TEXT_FEATURES], both[:, TEXT_FEATURES:]]))
        return out

    return hand


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


COLUMNS = {"id": "doc_id", "text": "text", "lang": "lang", "source": "source"}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", columns: dict[str, str] = COLUMNS, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` labelled ids that are not held out, and on all unlabelled ones.

    Null ids and labels take no part; of conflicting labels of an id the lower counts, of its
    rows the greatest; an empty table or labels of one kind give a constant model.
    """
    own = docs.select(*_columns(docs, columns)).where(F.col("id").isNotNull())
    read = materialize(arrow_map(own, _read_texts, f"id long, x array<float>, {META}"), "text-views")
    key = F.col(f"`{columns['id']}`").cast("long")
    names = materialize(labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("id").isNotNull()), "labels")
    known = names.where(F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # Bounded by max_labelled rows of 12 bytes, hence the broadcast.
    values = F.struct("lang", "source", "n_chars", "n_lines", "x")
    rows = read.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.max(values).alias("v")).orderBy(F.xxhash64("id"), "id").collect()
    x = [np.array([r["v"]["x"] for r in rows], dtype=float).reshape(-1, TEXT_FEATURES), meta_features(*([r["v"][c] for r in rows] for c in ("lang", "source", "n_chars", "n_lines")))]
    y = np.array([float(r["label"] > 0) for r in rows])
    labelled = KeyFilter(names, "id")
    pool = labelled.never(read, "id").unionByName(labelled.maybe(read, "id").join(names, "id", "left_anti"))
    return co_train(x, y, unlabelled(materialize(pool, "unlabelled")))


SCORED = "struct<score: double, text_score: double, meta_score: double>"


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", columns: dict[str, str] = COLUMNS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, text_score, meta_score for every row of ``docs``.

    Scores are probabilities that the label is 1.  Nulls in any column are a value of their
    own (a null text is empty); missing metadata columns count as null; of conflicting
    labels of one id the lower counts; without labels of both kinds every document gets
    one constant score; repeated rows each get a row.
    """
    model = fit(docs, labels, label_col, columns, max_labelled)

    @F.arrow_udf(SCORED)
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array, n_lines: pa.Array) -> pa.Array:
        x = [text_features(text.to_pylist()), meta_features(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist(), n_lines.to_pylist())]
        both, own = model.score(x)
        return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in (both, *own)], ["score", "text_score", "meta_score"])

    prepare(docs.sparkSession)
    out = docs.select(*_columns(docs, columns)).select("id", score("text", "lang", "source", "n_chars", "n_lines").alias("s"))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.text_score", "s.meta_score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
