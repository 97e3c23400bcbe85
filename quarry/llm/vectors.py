"""Shared by the searches over vectors: rows that take part, exact integer products, blocks against lanes.

A stated set of query rows meets all rows in blocks.  The rows are dealt to *lanes* and the
queries to *blocks*, both of bounded size and by a hash of the row's place, so that no id,
label or vector, however frequent, makes one of them large.  Each pair of a lane and a block is one
group of a cogroup: Spark shuffles the pairs, a task holds one of them, and a lost one is computed again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ARROW_ROWS, prepare

#: Components of a lane's and of a block's vectors, and rows, at most.
LANE_VALUES, BLOCK_VALUES = 1 << 21, 1 << 18
LANE_ROWS, BLOCK_ROWS = 1 << 15, 1 << 12
#: Integers of doubles are exact below this.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def is_usable(vec: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad)


def usable_rows(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """vec_id, vec, row (a place, once the table is stored), and ``more``, of the rows that take part."""
    vec = F.col(f"`{vec_col}`")
    return df.where(is_usable(vec)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"), *more).withColumn("row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Sizes:
    """How many lanes and blocks there are."""

    lanes: int
    blocks: int

    @staticmethod
    def of(rows: DataFrame, queries: DataFrame) -> Sizes:
        """For stored tables of rows and queries; two lanes a core at least, so that small tables use all cores."""
        n, values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
        q, asked = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
        cores = rows.sparkSession.sparkContext.defaultParallelism
        lanes = max(-(-n // LANE_ROWS), -(-values // LANE_VALUES), min(n, 4 * cores), 1)
        return Sizes(lanes, max(-(-q // BLOCK_ROWS), -(-asked // BLOCK_VALUES), 1))


def pair_up(rows: DataFrame, queries: DataFrame, sizes: Sizes, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search`` of each block of ``queries`` in each lane of ``rows``; both have a column ``row``.

    The two are stored apart: a cogroup of two views of one table mixes up their columns.
    """
    prepare(rows.sparkSession, ARROW_ROWS)
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("lane", own(sizes.lanes)).withColumn("block", every(sizes.blocks))
    right = queries.withColumn("block", own(sizes.blocks)).withColumn("lane", every(sizes.lanes))
    return left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block")).applyInArrow(search, schema)


def matrices(vectors: pa.Array | pa.ChunkedArray, scale: float | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: their places in the column, and each as a row, as floor(scale * x) if there is a scale.

    Scaling by a power of two and rounding down are exact in doubles, so the rows hold whole numbers.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
        if isinstance(vectors, pa.ChunkedArray):
            vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    lengths = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if scale is not None:
        with np.errstate(over="ignore"):
            flat = np.clip(np.floor(flat * scale), -1e300, 1e300)
    first = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = at, flat[first[at][:, None] + np.arange(n)]
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows; infinite beyond doubles."""
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", x, x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b`` as 64-bit integers.

    Doubles are exact while the lengths' product bounds every partial sum; rows beyond that are
    multiplied as Python integers, and a product beyond 64 bits counts as the last integer there is.
    """
    long_a, long_b = np.sqrt(norms(a)), np.sqrt(norms(b))
    most = long_a.max(initial=0.0) * long_b.max(initial=0.0)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    small_a, small_b = long_a < 1 << 26, long_b < 1 << 26
    out[np.ix_(small_a, small_b)] = (a[small_a] @ b[small_b].T).astype(np.int64)
    whole_b = [list(map(int, y)) for y in b]
    for i, x in enumerate(a):
        whole = list(map(int, x))
        for j in range(len(b)) if not small_a[i] else np.flatnonzero(~small_b).tolist():
            out[i, j] = min(MOST, max(LEAST, sum(p * q for p, q in zip(whole, whole_b[j], strict=True))))
    return out


def ids_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers for ties, and which are null; a null one comes after all others."""
    null = column.is_null().to_numpy()
    return np.where(null, MOST, column.fill_null(0).to_numpy()), null
