"""Exact deduplication with a log-structured merge index of text digests.

* **Memtable.**  The digests of all rows are taken in by blocks of arrivals.  A block is one
  memtable, spread over the executors: rows of a digest meet in map-side aggregation, so a
  text that fills a third of all rows leaves each task as one entry.
* **Flush.**  A memtable is flushed as sorted digest runs, one per range of digests, with a
  filter of its digests, a bounded bit table.
* **Hits.**  A digest that a memtable holds twice is a hit, and one that an earlier run
  holds: a memtable probes the earlier runs, and only digests that pass their filters are
  looked up in them.
* **Compaction.**  As soon as a level holds ``FANOUT`` runs they are merged into one of the
  next level; of equal digests the preferred identifier survives (the largest or the
  smallest) and sizes add up.  So a memtable probes few runs.
* **Verification.**  What the merged runs say of a hit holds for its rows once their bytes are
  compared: a digest with two texts, a collision, is split by bytes instead of merging them.

All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import KeyFilter, delete, discard, materialize, new_path, row_hash

#: Rows of a memtable.  There are four memtables at least and, as each is spread over all
#: executors, 16 at most: then they grow with the table.
MEMTABLE_ROWS, LEAST_MEMTABLES, MOST_MEMTABLES = 20_000_000, 4, 16
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Ranges of digests at most.
MAX_SHARDS = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty.

    ``lower`` does the same, and faster, for a text without other than ASCII characters.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@dataclass
class Run:
    """A flushed or merged set of sorted runs, one per range of digests; its filter is made when it is first probed."""

    path: str
    level: int
    filter: KeyFilter | None = None


class DigestIndex:
    """The runs below ``path``: entries of digest, preferred identifier and size."""

    SCHEMA = "digest binary, best long, size long, shard int"

    def __init__(self, spark: SparkSession, path: str, keep: str = "max", shards: int | None = None, fanout: int = FANOUT):
        if keep not in ("max", "min"):
            raise ValueError("keep is 'max' or 'min'")
        self.spark, self.path, self.keep, self.fanout = spark, path, keep, fanout
        self.shards = shards or min(MAX_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[Run] = []
        self._written = 0
        self._hits: list[DataFrame] = []

    def _best(self, col: str) -> Column:
        return (F.max if self.keep == "max" else F.min)(col)

    def _write(self, entries: DataFrame, level: int) -> Run:
        path = f"{self.path}/level{level}-{self._written}"
        self._written += 1
        first = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("long")
        shard = F.floor(first * self.shards / 65536).cast("int")  # ranges of the digest
        entries.withColumn("shard", shard).repartition(self.shards, "shard").sortWithinPartitions("shard", "digest").write.partitionBy("shard").parquet(path)
        return Run(path, level)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(path)

    def flush(self, rows: DataFrame) -> None:
        """Take in a memtable of ``rows`` (digest, id): probe the runs, write its own, merge full levels."""
        memtable = rows.groupBy("digest").agg(self._best("id").alias("best"), F.count("*").alias("size"))
        run = self._write(memtable, 0)
        own = self._read(run.path)
        hits = own.where(F.col("size") > 1).select("digest")
        for earlier in self.runs:
            hits = hits.unionByName(self._probe(own, earlier).select("digest"))
        self._hits.append(materialize(hits, "hits"))
        self.runs.append(run)
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= self.fanout:
            self._merge(full, level + 1)
            level += 1

    def _probe(self, digests: DataFrame, run: Run) -> DataFrame:
        """Digests that a run holds, with its entries; its filter turns others away before they are looked up."""
        if run.filter is None:
            run.filter = KeyFilter(self._read(run.path), "digest")
            run.filter.table = materialize(run.filter.table, "run-filter")
        found = self._read(run.path).select("digest", F.col("best").alias("found"), F.col("size").alias("found_size"))
        return run.filter.maybe(digests.select("digest"), "digest").join(found, "digest")

    def _merge(self, runs: list[Run], level: int) -> None:
        merged = reduce(DataFrame.unionByName, [self._read(r.path) for r in runs]).groupBy("digest").agg(self._best("best").alias("best"), F.sum("size").alias("size"))
        new = self._write(merged, level)
        self.runs = [r for r in self.runs if r not in runs] + [new]
        for r in runs:
            delete(self.spark, r.path)
            if r.filter:
                discard(r.filter.table)

    def compact(self) -> DataFrame:
        """Merge all runs into one and return its entries: digest, best, size."""
        if len(self.runs) > 1:
            self._merge(self.runs, 1 + max(r.level for r in self.runs))
        return self._read(self.runs[0].path).select("digest", "best", "size")

    def hits(self) -> DataFrame:
        """The digests that came more than once."""
        return reduce(DataFrame.unionByName, self._hits).distinct()

    def probe(self, digests: DataFrame) -> DataFrame:
        """digest, best, size of those of ``digests`` that some run holds."""
        found = reduce(DataFrame.unionByName, [self._probe(digests, r) for r in self.runs])
        return found.groupBy("digest").agg(self._best("found").alias("best"), F.sum("found_size").alias("size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row.

    ``row`` is the digest of identifier and text as they came.
    Texts are equal when identical after lower-casing A-Z.  A null text is empty and equals
    other empty texts.  Of rows that share both id and text each is returned, and each
    whose id is the kept one counts as kept.  A row without an id is kept only when no row
    of its group has one.  Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), normalized(F.col(f"`{text_col}`")).alias("norm"), row_hash(id_col, text_col).alias("row"))
    rows = rows.withColumn("digest", digest_of(F.col("norm")))

    # The digests are written once, a folder for each memtable.
    n = min(MOST_MEMTABLES, max(LEAST_MEMTABLES, -(-docs.count() // memtable_rows)))
    path = new_path(spark, "digests")
    rows.select("id", "row", "digest", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block")).write.partitionBy("block").parquet(path)
    ids = spark.read.schema("id long, row binary, digest binary, block int").parquet(path)
    index = DigestIndex(spark, new_path(spark, "digest-index"), keep)
    for block in range(n):
        index.flush(ids.where(F.col("block") == block).select("digest", "id"))

    # What stays, and how many there are, is what compaction kept for the hits.
    hits = materialize(index.hits(), "hits")
    settled = materialize(index.compact().join(hits, "digest", "left_semi"), "settled")
    # Byte verification of the hits.  Rows that cannot be hits go on the map side.  Equal
    # texts meet before the shuffle, so a frequent text costs a row per task.
    suspects = KeyFilter(hits, "digest").maybe(rows, "digest")
    texts = suspects.select("digest", "norm").distinct().groupBy("digest").agg(F.count("*").alias("texts"))
    split = materialize(texts.where("texts > 1").select("digest"), "split")
    out = ids.select("id", "row", "digest")
    # Two texts under one digest: never seen, but then the bytes decide.
    several = not split.isEmpty()
    if several:
        out, settled = (d.join(split, "digest", "left_anti") for d in (out, settled))
    out = out.join(settled, "digest", "left").select("id", "row", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best")).alias("best"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), "digest")
    if several:
        best = F.max if keep == "max" else F.min
        own = suspects.join(split, "digest", "left_semi")
        by_bytes = own.groupBy("digest", "norm").agg(best("id").alias("best"), F.count("*").alias("size"))
        out = out.unionByName(own.join(by_bytes, ["digest", "norm"]).select("id", "row", "best", "size", "digest"))
    return out.select(F.col("id").alias("doc_id"), F.col("best").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("best")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


OP6_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
