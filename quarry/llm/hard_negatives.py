"""Hard negatives: near misses of another label, by a search over buckets of norms.

An anchor's positives are its best rows of the same label.  Each positive opens a window of
scores, from a share of its own score up to that score; the best rows of other labels in the window are its hard negatives.

* **Buckets.**  The rows of a lane are sorted by label and then by norm, longest first, and cut into buckets; a
  bucket knows its longest norm.
* **Bounds.**  No row of a bucket scores more than the anchor's norm times the bucket's (Cauchy-Schwarz).  A
  bucket whose bound lies below the lower limit of a window, or below its running k-th score, is
  left out for that window; as norms fall, so are all later buckets of the label.
* **Scores.**  What is left is multiplied exactly, a bucket with all anchors that still want it at once.

Both searches, for positives and for negatives, run in pairs of lanes and blocks of anchors.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.vectors import Sizes, ids_of, matrices, norms, pair_up, products, usable_rows

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 5
#: The window: a negative has this share of the positive's score at least, in hundredths, and no more than all of it.
LEAST_SHARE = 80
#: Rows of a bucket.
BUCKET = 512
#: By how much bounds are widened, far more than doubles lose.
SLACK = 1e-9

FOUND = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, vec_id long, score long"


@dataclass
class Bucket:
    """Rows of one label: their places in the lane, and the longest norm among them."""

    label: int
    rows: np.ndarray
    x: np.ndarray
    longest: float


def buckets(x: np.ndarray, at: np.ndarray, labels: np.ndarray, size: int = BUCKET) -> list[list[Bucket]]:
    """For each label its buckets, longest norms first.  ``at`` are the places of the rows of ``x`` in the lane."""
    length = np.sqrt(norms(x))
    order = np.lexsort((at, -length, labels[at]))
    cuts = np.flatnonzero(np.diff(labels[at][order])) + 1
    out = []
    for own in np.split(order, cuts):
        pieces = [own[k : k + size] for k in range(0, len(own), size)]
        out.append([Bucket(int(labels[at[p[0]]]), at[p], x[p], float(length[p[0]])) for p in pieces])
    return out


class Best:
    """The running ``k`` best of a window: scores from ``low`` to ``high``, ties by id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.kept: list[tuple[int, int, int]] = []  # (-score, id, place), sorted

    def wants(self, bound: float) -> bool:
        """Whether a score of ``bound`` at most may still come in."""
        if self.low is not None and bound < self.low:
            return False
        return len(self.kept) < self.k or bound >= -self.kept[-1][0]

    @property
    def least(self) -> int | None:
        """Scores below this do not come in."""
        running = -self.kept[-1][0] if len(self.kept) == self.k else None
        return running if self.low is None else self.low if running is None else max(self.low, running)

    def offer(self, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        least = self.least
        good = np.ones(len(scores), dtype=bool) if least is None else scores >= least
        if self.high is not None:
            good &= scores <= self.high
        at = np.flatnonzero(good)
        if len(at) > 4 * self.k:
            at = at[np.lexsort((places[at], ids[at], -scores[at]))[: self.k]]
        for j in at.tolist():
            insort(self.kept, (-int(scores[j]), int(ids[j]), int(places[j])))
        del self.kept[self.k :]


def sweep(own: list[Bucket], anchors: np.ndarray, windows: list[list[Best]], ids: np.ndarray, skip: np.ndarray | None = None) -> int:
    """Offer the buckets of one label to the windows of each anchor; how many products were made.

    ``skip``: the place in the lane that is the anchor itself, or -1.
    """
    length, made = np.sqrt(norms(anchors)), 0
    left = np.arange(len(anchors))
    for b in own:
        bound = length * b.longest * (1 + SLACK) + 1
        # Norms only fall, and what a window wants only rises, so who leaves a label does not come back.
        left = left[[any(w.wants(bound[i]) for w in windows[i]) for i in left.tolist()]] if len(left) else left
        if not len(left):
            break
        scores = products(anchors[left], b.x)
        made += scores.size
        for s, i in zip(scores, left.tolist(), strict=True):
            # One look at the whole bucket for all windows; most rows are below all of them.
            least = [w.least for w in windows[i]]
            near = np.arange(len(s)) if None in least else np.flatnonzero(s >= min(least))
            if skip is not None and skip[i] >= 0:
                near = near[b.rows[near] != skip[i]]
            if len(near):
                places = b.rows[near]
                for w in windows[i]:
                    w.offer(s[near], ids[places], places)
    return made


def lower_limit(positive_score: int, least_share: int = LEAST_SHARE) -> int:
    """The least whole score of which the share of the positive's is not more."""
    return -((-least_share * positive_score) // 100)


def _lanes(rows: pa.Table, anchors: pa.Table, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[Bucket]], np.ndarray]]:
    """For each length of vectors: places of the anchors, the anchors, the buckets by label, the labels of the anchors."""
    if not rows.num_rows or not anchors.num_rows:
        return
    labels, own = rows["label"].to_numpy(), anchors["label"].to_numpy()
    lane = matrices(rows["vec"], scale)
    for n, (which, a) in matrices(anchors["vec"], scale).items():
        if n in lane:
            at, x = lane[n]
            yield which, a, buckets(x, at, labels), own[which]


def _table(out: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in FOUND.split(", ")]
    cols = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def _rows_of(anchors: pa.Table, rows: pa.Table):
    """The output rows for what a window kept."""
    anchor_row, anchor_id = anchors["row"].to_pylist(), anchors["vec_id"].to_pylist()
    row, vec_id = rows["row"].to_pylist(), rows["vec_id"].to_pylist()

    def of(i: int, positive: tuple, kept: list[tuple[int, int, int]]) -> Iterator[tuple]:
        for minus, _, place in kept:
            yield (anchor_row[i], anchor_id[i], *positive, row[place], vec_id[place], -minus)

    return of


def _positives(scale: float, k: int):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, _ = ids_of(rows["vec_id"])
        place = {r: j for j, r in enumerate(rows["row"].to_pylist())}
        skip = np.array([place.get(r, -1) for r in anchors["row"].to_pylist()], dtype=np.int64)
        of = _rows_of(anchors, rows)
        for which, a, by_label, own in _lanes(rows, anchors, scale):
            windows = [[Best(k)] for _ in which]
            for bs in by_label:
                mine = np.flatnonzero(own == bs[0].label)
                sweep(bs, a[mine], [windows[i] for i in mine.tolist()], ids, skip[which[mine]])
            for i, (w,) in zip(which.tolist(), windows, strict=True):
                out += of(i, (None, None, None), w.kept)
        return _table(out)

    return search


def _negatives(scale: float, k: int, least_share: int):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, _ = ids_of(rows["vec_id"])
        of, positives = _rows_of(anchors, rows), anchors["positives"].to_pylist()
        for which, a, by_label, own in _lanes(rows, anchors, scale):
            # A score below 0 has no window: its share is more than itself.
            windows = [[Best(k, lower_limit(p["score"], least_share), p["score"]) for p in positives[i]] for i in which.tolist()]
            for bs in by_label:
                others = np.flatnonzero(own != bs[0].label)
                sweep(bs, a[others], [windows[i] for i in others.tolist()], ids)
            for i, ws in zip(which.tolist(), windows, strict=True):
                for p, w in zip(positives[i], ws, strict=True):
                    out += of(i, (p["row"], p["vec_id"], p["score"]), w.kept)
        return _table(out)

    return search


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become ``floor(scale * x)``; a score is the inner product with the anchor.  Anchors are the rows whose id
    is divisible by ``every``.  Each has as positives its best ``positives`` other rows of the same label, and each
    positive the best ``negatives`` rows of other labels whose score s satisfies
    ``least_share * p <= 100 * s <= 100 * p`` for the positive's score p.
    Equal scores go by the smaller id, null ids last.  Rows with a null label, a null vector, or a null or non-finite component take
    no part; vectors of different lengths do not meet; scores beyond 64 bits count as the last integer there is.
    Rows that share an id count each; a row with a null id is no anchor.  An anchor without positives or
    without a negative in a window gives no rows for it.  Other columns are ignored; an empty table gives no rows.
    """
    labelled = vectors.where(F.col(f"`{label_col}`").isNotNull())
    rows = materialize(usable_rows(labelled, id_col, vec_col, F.col(f"`{label_col}`").cast("long").alias("label")), "labelled-vectors")
    anchors = materialize(rows.where(F.col("vec_id") % every == 0), "anchors")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))

    sizes = Sizes.of(rows, anchors)
    found = pair_up(rows, anchors, sizes, _positives(scale, positives), FOUND)
    found = materialize(found.withColumn("rank", best("anchor_row")).where(F.col("rank") <= positives).select("anchor_row", "row", "vec_id", "score"), "positives")
    # At most `positives` a row of this group.
    per_anchor = found.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "row"))).alias("positives"))
    with_positives = anchors.join(per_anchor.withColumnRenamed("anchor_row", "row"), "row")
    found = pair_up(rows, with_positives, sizes, _negatives(scale, negatives, least_share), FOUND)
    ranked = found.withColumn("rank", best("anchor_row", "positive_row")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label becomes the next of ten first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
