"""Tables and folders that are derived from files, kept by what they were derived from.

What is kept has the digest of its inputs in its name: the path below the input folder, size and time of every file, combined without
regard to their order, so neither the list of files nor any content is gathered in one place.  While
the inputs are unchanged, what is kept is read, and nothing is read or parsed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.stored import delete, new_path, shared_dir
from quarry.registry import query
from quarry.sources.tables import table


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below ``paths``; a path without files adds nothing."""
    parts = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
        key = [F.substring_index(below, path.rstrip("/").split("/")[-1], -1), F.col("length"), F.unix_micros("modificationTime")]
        # Sum and exclusive or of two hashes don't depend on the order of the files.
        one = files.agg(F.count("*"), F.sum(F.xxhash64(*key).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *key)), F.sum("length")).first()
        parts.append(":".join(map(str, one)))
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Derived:
    """What is derived, below ``root``; without one, in a folder that goes with the application."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/derived"
        #: How often something had to be made.
        self.made = 0
        if root is None:
            new_path(spark, "derived")  # the application's folder is deleted with it

    def _place(self, name: str, paths: list[str], version: int) -> str:
        return f"{self.root}/{name}/{version}-{fingerprint(self.spark, paths)}"

    def folder(self, name: str, paths: list[str], make: Callable[[str], None], version: int = 1) -> str:
        """The folder that ``make`` fills from the files below ``paths``; another ``version`` of the format is made anew.

        A folder that was not finished is made again.
        """
        place = self._place(name, paths, version)
        if not _exists(self.spark, f"{place}/_DONE"):
            delete(self.spark, place)
            make(place)
            done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_DONE")
            done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(done).close()
            self.made += 1
        return place

    def table(self, name: str, paths: list[str], make: Callable[[], DataFrame], version: int = 1) -> DataFrame:
        """The table that ``make`` gives, stored."""
        return self.spark.read.parquet(self.folder(name, paths, lambda place: make().write.parquet(f"{place}/table"), version) + "/table")


@query("s12_cached_derivation", """WITH s AS (SELECT s_nationkey AS folder, count(*) AS n FROM supplier GROUP BY 1), r(run, made, changed) AS (VALUES (1, 1, false), (2, 1, false), (3, 2, true), (4, 3, true))
  SELECT run, CAST(made AS BIGINT) AS made, folder, CAST(CASE WHEN changed AND folder = (SELECT min(folder) FROM s) THEN 2 * n ELSE n END AS BIGINT) AS lines FROM r, s""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts of files, derived four times: at first, unchanged, after one file changed, and with another version of the format."""
    path = new_path(spark, "cached")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("folder"), "s_name")
    rows.write.partitionBy("folder").option("compression", "none").text(f"{path}/in")
    kept, out = Derived(spark, f"{path}/kept"), None
    count = lambda: spark.read.text(f"{path}/in").groupBy("folder").agg(F.count("*").alias("lines"))
    for run, version in ((1, 1), (2, 1), (3, 1), (4, 2)):
        if run == 3:
            least = rows.agg(F.min("folder")).first()[0]
            rows.where(F.col("folder") == least).select("s_name").write.mode("append").text(f"{path}/in/folder={least}")
        found = kept.table("lines", [f"{path}/in"], count, version)
        one = found.select(F.lit(run).alias("run"), F.lit(kept.made).cast("long").alias("made"), "folder", "lines")
        out = one if out is None else out.unionByName(one)
    return out
