"""Exact top-k by inner product, with a table of distances to pivots.

* **Pivots.**  Some vectors far from each other, chosen from a bounded sample of the rows.  What is
  chosen changes the work, never the result.
* **Table.**  The distance of every row to every pivot is computed once and stored with the row.
* **Bounds.**  By the triangle inequality a row is at least ``|d(q, p) - d(x, p)|`` away from the
  query, for every pivot; the largest of these is its bound.  As ``2 q.x = |q|^2 + |x|^2 - d(q, x)^2``, a lower bound of
  the distance is an upper bound of the score.
* **Search.**  In a lane the rows are evaluated exactly in the order of their bounds, until the
  next bound is below the running k-th score; all that follow are eliminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, materialize
from quarry.llm.vectors import Sizes, ids_of, matrices, norms, pair_up, products, usable_rows

SCALE, TOP = 1024.0, 10
#: Pivots, and rows of the sample from which they are chosen.
PIVOTS, SAMPLE = 32, 2_048
#: Share by which bounds are widened, far more than doubles lose.
SLACK = 1e-9
#: Rows that are evaluated at once, at first; then twice as many each time.
FIRST = 64


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows, each as far as possible from those before."""
    chosen: list[int] = []
    nearest = np.full(len(x), np.inf)
    while len(chosen) < n and nearest.max(initial=0.0) > 0:
        chosen.append(int(nearest.argmax()))
        with np.errstate(over="ignore", invalid="ignore"):
            nearest = np.fmin(nearest, norms(x - x[chosen[-1]]))
        nearest[chosen[-1]] = 0.0
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One row for each of ``x``, one column for each pivot."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(norms(x - p))
    return out


def top_by_bounds(q: np.ndarray, to_pivots: np.ndarray, x: np.ndarray, table: np.ndarray, ids: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the ``k`` best of ``x``, ties by ids, without row ``own``; and how many were evaluated."""
    square_q, square_x = norms(q[None])[0], norms(x)
    with np.errstate(over="ignore", invalid="ignore"):
        apart = np.fmax.reduce(np.abs(table - to_pivots), axis=1, initial=0.0)
        apart = np.maximum(apart * (1 - SLACK) - SLACK * np.sqrt(square_q + square_x), 0.0)
        bound = (square_q + square_x - apart * apart) / 2 + SLACK * (square_q + square_x) + 1
    bound[~np.isfinite(bound)] = np.inf
    if own >= 0:
        bound[own] = -np.inf
    order = np.argsort(-bound, kind="stable")[: len(x) - (own >= 0)]
    rows, scores, at, step = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, FIRST
    while at < len(order) and not (len(rows) == k and bound[order[at]] < scores[-1]):
        more = order[at : at + step]
        rows, scores = np.concatenate([rows, more]), np.concatenate([scores, products(q[None], x[more])[0]])
        if len(rows) > 4 * k:  # only rows as good as the k-th take part in the sort
            good = scores >= np.partition(scores, -k)[-k]
            rows, scores = rows[good], scores[good]
        best = np.lexsort((rows, ids[rows], -scores))[:k]
        rows, scores = rows[best], scores[best]
        at, step = at + len(more), 2 * step
    return rows, scores, at


def _pivots_of(rows: DataFrame, scale: float, n: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors that the sample has."""
    sample = rows.select("vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    return {length: choose_pivots(x, n) for length, (_, x) in matrices(sample["vec"], scale).items()}


def _add_table(rows: DataFrame, pivots: dict[int, np.ndarray], scale: float) -> DataFrame:
    """``rows`` with ``table``: the distances to the pivots for vectors of that length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[]] * batch.num_rows
            for length, (at, x) in matrices(batch.column("vec"), scale).items():
                if length in pivots:
                    for k, d in zip(at.tolist(), distances(x, pivots[length]), strict=True):
                        out[k] = d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "table"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return arrow_map(rows, task, f"{fields}, table array<double>")


def _search(scale: float, k: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        ids, null = ids_of(rows["vec_id"])
        places, asked = rows["row"].to_numpy(), queries["row"].to_numpy()
        stored, wanted = matrices(rows["table"]) if rows.num_rows else {}, matrices(queries["table"])
        table_of = {int(r): t for at, m in stored.values() for r, t in zip(at, m, strict=True)}
        query_table = {int(r): t for at, m in wanted.values() for r, t in zip(at, m, strict=True)}
        lanes = matrices(rows["vec"], scale) if rows.num_rows else {}
        for length, (which, x) in matrices(queries["vec"], scale).items():
            if length not in lanes:
                continue
            at, y = lanes[length]
            table = np.array([table_of[int(r)] for r in at])
            where = {int(r): j for j, r in enumerate(places[at])}
            for i, q in zip(which.tolist(), x, strict=True):
                best, scores, _ = top_by_bounds(q, query_table[i], y, table, ids[at], k, where.get(int(asked[i]), -1))
                for col, v in zip(cols, (np.full(len(best), asked[i]), at[best], scores), strict=False):
                    col.append(v)
        query, found, score = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in cols[:3])
        query_id = dict(zip(asked.tolist(), queries["vec_id"].to_pylist(), strict=True))
        arrays = [pa.array(query, pa.int64()), pa.array([query_id[int(r)] for r in query], pa.int64()), pa.array(ids[found], pa.int64(), mask=null[found]), pa.array(places[found], pa.int64()), pa.array(score, pa.int64())]
        return pa.Table.from_arrays(arrays, ["query_row", "query_id", "vec_id", "row", "score"])

    return search


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = TOP, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner product for each query.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but the query's own.  Equal scores go by the smaller id, null ids last.  Null
    vectors and such with null or non-finite components take no part; vectors of
    different lengths do not meet; scores beyond 64 bits count as the last integer there is.
    Rows that share an id are queries and candidates of their own.  A row with a
    null id is no query.  Other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(usable_rows(vectors, id_col, vec_col), "vectors")
    chosen = _pivots_of(rows, scale, pivots)
    rows = materialize(_add_table(rows, chosen, scale), "pivot-table")
    queries = materialize(rows.where(F.col("vec_id") % every == 0), "query-vectors")
    found = pair_up(rows, queries, Sizes.of(rows, queries), _search(scale, k), "query_row long, query_id long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
