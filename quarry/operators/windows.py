"""Row frames, runs, islands, look-ahead, decayed sums and ordered folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.order import values_at
from quarry.registry import query
from quarry.sources.tables import CALLS_SQL, CHUNKS_SQL, calls, chunks, table


@query("w1_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"))


def repeats_in_frame(rows: DataFrame, key: str, order: str, item: str, frame: int) -> DataFrame:
    """How often the row's item occurs in the last ``frame`` rows of its key, this one included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(frame - 1), 0)
    return rows.withColumn("_l", F.collect_list(item).over(w)).withColumn("repeats", F.size(F.filter("_l", lambda x: x == F.col(item))).cast("long")).drop("_l")


@query("w2_repeated_errors", f"WITH {CALLS_SQL}, l AS (SELECT event_id, tool, failed, list(tool) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM calls) SELECT event_id, len(list_filter(l, lambda x: x = tool)) AS repeats FROM l WHERE failed AND len(list_filter(l, lambda x: x = tool)) >= 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_in_frame(calls(spark, sf_dir), "user_id", "seq", "tool", 10).where("failed and repeats >= 3").select("event_id", "repeats")


@query("w3_repeated_edits", f"WITH {CALLS_SQL}, l AS (SELECT event_id, tool, list(tool) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS l FROM calls) SELECT event_id, len(list_filter(l, lambda x: x = tool)) AS repeats FROM l WHERE len(list_filter(l, lambda x: x = tool)) >= 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_in_frame(calls(spark, sf_dir), "user_id", "seq", "tool", 15).where("repeats >= 5").select("event_id", "repeats")


def greedy_triples(rows: DataFrame, key: str, order: str, step: str, pattern: tuple[str, str, str]) -> DataFrame:
    """Non-overlapping occurrences of three steps in a row, taken from the left, for each key.

    Occurrences of three different steps cannot overlap, so all of them count, and no key's steps are gathered.
    """
    if len(set(pattern)) == 3:
        w = Window.partitionBy(key).orderBy(order)
        found = (F.col(step) == pattern[0]) & (F.lead(step, 1).over(w) == pattern[1]) & (F.lead(step, 2).over(w) == pattern[2])
        return rows.select(key, found.alias("_found")).groupBy(key).agg(F.count_if("_found").alias("cycles"))
    ordered = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, step))), lambda x: x[step]).alias("s"))
    zero = F.struct(F.lit(0).alias("skip"), F.lit(0).cast("long").alias("n"))
    hit = lambda i: (F.get("s", i) == pattern[0]) & (F.get("s", i + 1) == pattern[1]) & (F.get("s", i + 2) == pattern[2])
    fold = F.aggregate(
        F.sequence(F.lit(0), F.size("s") - 1),
        zero,
        lambda a, i: F.when(a["skip"] > 0, F.struct((a["skip"] - 1).alias("skip"), a["n"].alias("n"))).when(F.coalesce(hit(i), F.lit(False)), F.struct(F.lit(2).alias("skip"), (a["n"] + 1).alias("n"))).otherwise(a),
    )
    return ordered.select(key, fold["n"].alias("cycles"))


# Occurrences of a pattern of three different steps cannot overlap, so counting them all is the greedy count.
@query("w4_greedy_triples", f"WITH {CALLS_SQL}, t AS (SELECT user_id, seq, tool, lead(tool, 1) OVER (PARTITION BY user_id ORDER BY seq) AS b, lead(tool, 2) OVER (PARTITION BY user_id ORDER BY seq) AS c FROM calls) SELECT user_id, count(CASE WHEN tool = 'click' AND b = 'view' AND c = 'error' THEN 1 END) AS cycles FROM t GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_triples(calls(spark, sf_dir), "user_id", "seq", "tool", ("click", "view", "error"))


@query("w5_consecutive_failures", f"WITH {CALLS_SQL}, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM calls) SELECT event_id, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY seq) AS BIGINT) AS streak FROM g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("seq")
    g = calls(spark, sf_dir).withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order))
    return g.select("event_id", F.sum(F.col("failed").cast("long")).over(Window.partitionBy("user_id", "island").orderBy("seq")).alias("streak"))


@query("w6_look_ahead", f"""WITH {CALLS_SQL}, n AS (SELECT *, max(seq) OVER (PARTITION BY user_id) AS total FROM calls)
  SELECT a.event_id, coalesce(min(b.seq) IS NOT NULL, false) AS hit, round(ln(1 + coalesce(min_by(b.value, b.seq), 0)), 6) AS size, coalesce(min(b.seq - a.seq), 10) AS distance
  FROM n a LEFT JOIN n b ON b.user_id = a.user_id AND b.seq BETWEEN a.seq + 1 AND a.seq + 10 AND b.failed AND b.value > 20 WHERE a.seq + 10 <= a.total GROUP BY a.event_id""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("seq")
    ahead = F.collect_list(F.struct("seq", "failed", "value")).over(order.rowsBetween(1, 10))
    rows = calls(spark, sf_dir).withColumn("a", ahead).where(F.size("a") == 10)
    first = F.get(F.filter("a", lambda x: x["failed"] & (x["value"] > 20)), 0)
    f = rows.withColumn("f", first)
    return f.select("event_id", F.col("f").isNotNull().alias("hit"), F.round(F.log1p(F.coalesce("f.value", F.lit(0.0))), 6).alias("size"), F.coalesce((F.col("f.seq") - F.col("seq")).cast("long"), F.lit(10).cast("long")).alias("distance"))


#: Half-lives in a block of time; what is two blocks old counts less than 2^-500, that is, nothing.
BLOCK = 500


def decayed_sum(rows: DataFrame, key: str, order: str, seconds: str, half_life: float, least: float = 0.01) -> DataFrame:
    """Running sum in which each earlier row counts 2^(-age / half life); sums below ``least`` are null.

    Sums are scaled within blocks of time, so they stay finite however long a key lives.
    """
    block = F.floor(F.col(seconds) / (half_life * BLOCK)).cast("long")
    rows = rows.withColumn("_b", block).withColumn("_g", F.pow(F.lit(2.0), F.col(seconds) / half_life - F.col("_b") * BLOCK))
    own = F.sum("_g").over(Window.partitionBy(key, "_b").orderBy(order))
    before = F.coalesce(F.sum("_g").over(Window.partitionBy(key).orderBy("_b").rangeBetween(-1, -1)), F.lit(0.0))
    decayed = own / F.col("_g") + before * F.pow(F.lit(2.0), F.lit(-float(BLOCK))) / F.col("_g")
    return rows.withColumn("decayed", decayed).withColumn("decayed", F.when(F.col("decayed") >= least, F.col("decayed"))).drop("_g", "_b")


@query("w7_decayed_sum", f"WITH {CALLS_SQL}, s AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM calls) SELECT a.event_id, round(sum(pow(2.0, (b.t - a.t) / 259200.0)), 4) AS decayed FROM s a JOIN s b ON a.user_id = b.user_id AND b.seq <= a.seq GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return decayed_sum(c, "user_id", "seq", "t", 259200.0).select("event_id", F.round("decayed", 4).alias("decayed"))


@query("w8_percentile_cut", "WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER () AS n FROM supplier) SELECT s_suppkey FROM supplier WHERE s_acctbal >= (SELECT s_acctbal FROM r WHERE r.r = CAST(floor(n * 0.9) AS BIGINT) + 1)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    least = values_at(s, "s_acctbal", "s_suppkey", [math.floor(s.count() * 0.9)])[0]
    return s.where(F.col("s_acctbal") >= F.lit(least)).select("s_suppkey")


@query("w9_run_length", f"""WITH {CALLS_SQL}, b AS (SELECT *, CASE WHEN tool = lag(tool) OVER (PARTITION BY user_id ORDER BY seq) THEN 0 ELSE 1 END AS edge FROM calls),
  g AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM b) SELECT user_id, min(seq) AS first_seq, tool, count(*) AS n, CASE WHEN count(*) > 2 THEN tool || ' [repeated ' || (count(*) - 1) || ' more times]' ELSE tool END AS shown FROM g GROUP BY user_id, run, tool""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("seq")
    edge = F.when(F.col("tool") == F.lag("tool").over(order), 0).otherwise(1)
    runs = calls(spark, sf_dir).withColumn("edge", edge).withColumn("run", F.sum("edge").over(order))
    g = runs.groupBy("user_id", "run", "tool").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    shown = F.when(F.col("n") > 2, F.concat("tool", F.lit(" [repeated "), (F.col("n") - 1).cast("string"), F.lit(" more times]"))).otherwise(F.col("tool"))
    return g.select("user_id", "first_seq", "tool", "n", shown.alias("shown"))


@query("w11_first_occurrence", f"WITH {CHUNKS_SQL}, l AS (SELECT id, string_split(raw, chr(10)) AS ls, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS p FROM chunks), k AS (SELECT id, p, lower(trim(ls[p], ' ')) AS key FROM l) SELECT id, p AS line_no FROM k QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY p) = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Within a document: a line stays if its key has no earlier place; no shuffle.
    keys = chunks(spark, sf_dir).select("id", F.transform(F.split("raw", "\n"), lambda x: F.lower(F.trim(x))).alias("k"))
    rows = keys.select("id", "k", F.posexplode("k").alias("p", "key"))
    return rows.where(F.array_position("k", F.col("key")) == F.col("p") + 1).select("id", (F.col("p") + 1).cast("long").alias("line_no"))


def greedy_budget(items: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """Largest first; an item that would overflow is skipped and the next one tried."""
    ordered = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("s"), "id"))).alias("l"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fold = F.aggregate("l", zero, lambda a, x: F.when(a["used"] - x["s"] <= budget, F.struct((a["used"] - x["s"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a))
    return ordered.select(key, fold.alias("f")).select(key, F.col("f.used").alias("used"), F.size("f.ids").cast("long").alias("n"), F.array_join(F.col("f.ids").cast("array<string>"), ",").alias("ids"))


@query("w14_greedy_budget", """WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
  f AS (SELECT lang, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, '' AS ids FROM (SELECT DISTINCT lang FROM documents)
    UNION ALL SELECT f.lang, o.r, CASE WHEN used + n_chars <= 20000 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 20000 THEN n + 1 ELSE n END, CASE WHEN used + n_chars <= 20000 THEN CASE WHEN ids = '' THEN '' ELSE ids || ',' END || o.doc_id ELSE ids END FROM f JOIN o ON o.lang = f.lang AND o.r = f.r + 1)
  SELECT lang, max_by(used, r) AS used, max_by(n, r) AS n, max_by(ids, r) AS ids FROM f GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_budget(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars"), "lang", "n_chars", 20000)


@query("w15_ring_buffer", f"WITH {CALLS_SQL} SELECT event_id FROM calls QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 50")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seq")))
    return calls(spark, sf_dir).withColumn("r", r).where("r <= 50").select("event_id")


@query("x2_ttl_window", f"WITH {CALLS_SQL} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS alive FROM calls")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-24 * 3600 * 1_000_000, 0)
    return calls(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count("*").over(w).alias("alive"))


@query("x7_pressure", f"WITH {CALLS_SQL} SELECT event_id, round(least(1.0, sum(value) OVER (PARTITION BY user_id ORDER BY seq) / 2000.0), 6) AS pressure FROM calls")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("seq")
    return calls(spark, sf_dir).select("event_id", F.round(F.least(F.lit(1.0), F.sum("value").over(w) / 2000.0), 6).alias("pressure"))


@query("c16_cumulative_debt", f"WITH {CALLS_SQL}, d AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY seq), 10.0) AS delta FROM calls) SELECT event_id, round(sum(delta) OVER (PARTITION BY user_id ORDER BY seq), 6) + 0.0 AS debt FROM d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("seq")
    d = calls(spark, sf_dir).withColumn("delta", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(10.0)))
    return d.select("event_id", (F.round(F.sum("delta").over(w), 6) + 0.0).alias("debt"))


FOLD = {"error": 3.0, "signup": 10.0, "view": 1.0}


def fragility(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Ordered fold per key: +10 trip, +3 error, +1 heal, halved by success; the steps do not commute."""
    ordered = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind]).alias("_kinds"))
    step = lambda s, k: F.when(k == "purchase", s * 0.5).when(k == "signup", s + 10.0).when(k == "error", s + 3.0).when(k == "view", s + 1.0).otherwise(s)
    return ordered.select(key, F.round(F.aggregate("_kinds", F.lit(0.0), step), 6).alias("score"))


@query("x10_fragility", f"""WITH RECURSIVE {CALLS_SQL}, f AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS score FROM (SELECT DISTINCT user_id FROM events)
   UNION ALL SELECT f.user_id, c.seq, CASE c.tool WHEN 'purchase' THEN score * 0.5 WHEN 'signup' THEN score + 10 WHEN 'error' THEN score + 3 WHEN 'view' THEN score + 1 ELSE score END FROM f JOIN calls c ON c.user_id = f.user_id AND c.seq = f.seq + 1)
  SELECT user_id, round(max_by(score, seq), 6) AS score FROM f GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragility(calls(spark, sf_dir), "user_id", "seq", "tool")


@query("x8_drift_trigger", f"""WITH RECURSIVE {CALLS_SQL}, f AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS last, 0 AS fired FROM (SELECT DISTINCT user_id FROM events)
   UNION ALL SELECT f.user_id, c.seq, total + c.value, CASE WHEN total + c.value - last >= 500 AND c.tool <> 'error' THEN total + c.value ELSE last END, fired + CASE WHEN total + c.value - last >= 500 AND c.tool <> 'error' THEN 1 ELSE 0 END FROM f JOIN calls c ON c.user_id = f.user_id AND c.seq = f.seq + 1)
  SELECT user_id, CAST(max(fired) AS BIGINT) AS fired FROM f GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "tool"))).alias("l"))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("last"), F.lit(0).cast("long").alias("fired"))

    def step(a, x):
        total = a["total"] + x["value"]
        fire = (total - a["last"] >= 500) & (x["tool"] != "error")
        return F.struct(total.alias("total"), F.when(fire, total).otherwise(a["last"]).alias("last"), (a["fired"] + F.when(fire, 1).otherwise(0)).alias("fired"))

    return rows.select("user_id", F.aggregate("l", zero, step)["fired"].alias("fired"))
