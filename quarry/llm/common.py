"""Shared plumbing of the training-data operators: shared tables, Arrow maps, vocabulary files."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ship import ship

#: Rows handed to Python at once; texts are long, so a batch stays a few MB.
ARROW_ROWS = 256

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session where it is set; in a local session
    without it, one temporary folder per process.
    """
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return f"file://{_local_dir}"


_scope = ""
_to_delete: set[str] = set()


def _root(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver ends."""
    root = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"
    if root not in _to_delete:
        _to_delete.add(root)
        atexit.register(_delete_at_exit, spark, root)
    return root


def _delete_at_exit(spark: SparkSession, root: str) -> None:
    # The JVM may be gone by then; what it leaves is a folder named after the application.
    with contextlib.suppress(Exception):
        delete(spark, root)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{_scope}{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables made inside lie in a folder of that name, which is emptied first.

    For steps whose result is stored before the next step of that name begins: the tables
    that it was read from are then of no more use.
    """
    global _scope
    was, _scope = _scope, f"{name}/"
    try:
        delete(spark, f"{_root(spark)}/{_scope}")
        yield
    finally:
        _scope = was


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a table that outlives the executors which wrote it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing lazy reads any more."""
    for df in tables:
        delete(df.sparkSession, df._quarry_path)


def prepare(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """What Python stages need: the package on the executors, and batches of ``rows`` rows at most."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` with batches of at most ``rows`` rows."""
    prepare(df.sparkSession, rows)
    return df.mapInArrow(tidy(fn), schema)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after which a worker hands freed memory back, so that reused workers stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver and shipped with the tasks (a few MB, fixed)."""
    with open(path, "rb") as f:
        return f.read()


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns under fixed names, null text as empty; other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The 128-bit digest of identifier and text by which operators refer to rows."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(key, F.lit(":"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("binary")))


#: A filter of keys has so many slots of four 64-bit words at most: 2^28 bits, 32 MB.
SLOTS, WORDS = 1 << 20, 4
#: Keys for which a slot is added, so that a smaller filter passes about one other row in 64.
KEYS_A_SLOT = 4


def _place(key: Column, slots: int) -> tuple[Column, Column, Column]:
    """Slot, word and bit of a key."""
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(slots - 1).cast("long")), F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(WORDS - 1).cast("long")).cast("int"), F.shiftrightunsigned(h, 22).bitwiseAND(F.lit(63).cast("long")).cast("int")


class KeyFilter:
    """Which keys cannot be among given ones: one bit a key, in a table that is broadcast.

    The table grows with the number of keys up to its bound of ``SLOTS``; up to some 4
    million keys it passes one other row in 64, at 50 million one in six.  What it passes
    is always joined with the keys themselves, so it saves work and decides nothing.
    """

    def __init__(self, keys: DataFrame, col: str, n: int | None = None):
        """``keys`` is a stored table of ``n`` rows, counted here if not told."""
        n = keys.count() if n is None else n
        self._slots = 1
        while self._slots < min(SLOTS, n / KEYS_A_SLOT):
            self._slots *= 2
        slot, word, bit = _place(F.col(col), self._slots)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        words = [F.coalesce(F.bit_or(F.when(word == k, one)), F.lit(0).cast("long")) for k in range(WORDS)]
        self.table = keys.groupBy(slot.alias("_quarry_slot")).agg(F.array(*words).alias("_quarry_words"))

    def _join(self, df: DataFrame, col: str, how: str) -> DataFrame:
        slot, word, bit = _place(F.col(f"`{col}`"), self._slots)
        is_set = F.call_function("shiftrightunsigned", F.get("_quarry_words", word), bit).bitwiseAND(F.lit(1).cast("long")) == 1
        return df.join(F.broadcast(self.table), (slot == F.col("_quarry_slot")) & is_set, how)

    def maybe(self, df: DataFrame, col: str) -> DataFrame:
        """Rows of ``df`` whose key may be among the given ones."""
        return self._join(df, col, "left_semi")

    def never(self, df: DataFrame, col: str) -> DataFrame:
        """Rows of ``df`` whose key is not."""
        return self._join(df, col, "left_anti")


def _split(docs: DataFrame, rows: DataFrame) -> tuple[str, DataFrame, DataFrame]:
    """Name of a row-hash column, the rows of ``docs`` that cannot be among ``rows`` (stored), and the others.

    Told apart on the map side, so that only rows that may be among ``rows`` are shuffled later.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    known, marked = KeyFilter(rows, "row"), docs.withColumn(name, row_hash())
    return name, known.never(marked, name), known.maybe(marked, name)


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash is no ``row`` of ``gone``.

    Rows that share identifier and text go together; extra columns, clashing ones too,
    come through; without ``gone`` or ``docs`` nothing changes.
    """
    gone = materialize(gone.select("row").distinct(), "gone")
    name, clear, maybe = _split(docs, gone)
    maybe = maybe.join(gone.withColumnRenamed("row", name), name, "left_anti")
    return clear.unionByName(maybe.select(clear.columns)).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decided`` (row, kept) keeps; of rows with one hash only one."""
    repeated = materialize(decided.where("kept").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "repeated")
    if repeated.isEmpty():
        return drop_rows(docs, decided.where(~F.col("kept")))
    name, _, maybe = _split(docs, repeated)
    once = maybe.join(repeated.withColumnRenamed("row", name), name, "left_semi").dropDuplicates([name])
    rest = drop_rows(docs, decided.where(~F.col("kept")).select("row").unionByName(repeated))
    return rest.unionByName(once.select(*[F.col(f"`{c}`") for c in docs.columns]))
