"""The driver tables, and the relations that the operators are shown on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it has fewer partitions than the session has cores.

    A table in one small file is one task otherwise; a large table has partitions enough and stays as it is.  So does
    what shuffles deal out already: its partitions are known only when they have run, and to count them would run them twice.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: Folders that documents are dealt to, so that every path rule has rows.
FOLDERS = ["src", "test", "lib", "dist", "node_modules", "docs"]

CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS id, '/' || list_extract(['src','test','lib','dist','node_modules','docs'], CAST(doc_id % 6 AS INTEGER) + 1) || '/' || source || '/' || doc_id AS path,
         text AS raw, lang AS node_type, source AS symbol_name FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: id, path, raw, node_type, symbol_name."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang"))
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), folder, F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("raw"),
        F.col("lang").alias("node_type"),
        F.col("source").alias("symbol_name"),
    )


CALLS_SQL = """calls AS (
  SELECT user_id, event_id, ts, event_type AS tool, value, event_type = 'error' AS failed,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: user_id, event_id, ts, tool, value, failed, seq (per user)."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("tool"), "value", (F.col("event_type") == "error").alias("failed"), F.row_number().over(order).alias("seq"))


TRADE_SQL = """trade AS (
  SELECT src, dst, weight FROM (
    SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey
    WHERE c.c_nationkey <> s.s_nationkey GROUP BY 1, 2)
  QUALIFY weight > 1.25 * avg(weight) OVER ())"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between nations: src (customer's) buys from dst (supplier's), a quarter more lines than pairs do on average."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = joined.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    mean = pairs.agg(F.avg("weight").alias("_mean"))  # one row
    return pairs.crossJoin(F.broadcast(mean)).where(F.col("weight") > 1.25 * F.col("_mean")).drop("_mean")
