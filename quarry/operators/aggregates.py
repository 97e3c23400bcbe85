"""Sums, order statistics, histograms, entropies and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import round_half_up
from quarry.registry import query
from quarry.sources.tables import CALLS_SQL, CHUNKS_SQL, calls, chunks, table


def usage_totals(log: DataFrame, since: str | None = None) -> DataFrame:
    """Calls and token sums; zeros for an empty log."""
    if since:
        log = log.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return log.agg(F.count("*").alias("calls"), *[total(c).alias(c) for c in ("input_tokens", "output_tokens", "saved_tokens")])


USAGE_SQL = "usage AS (SELECT ts, event_type AS tool_name, CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens, CAST(floor(value * 5) AS BIGINT) AS saved_tokens FROM events)"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.floor(F.col("value") * k).cast("long")
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("tool_name"), part(10).alias("input_tokens"), part(3).alias("output_tokens"), part(5).alias("saved_tokens"))


_TOTALS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "saved_tokens"))


@query("a1_usage_totals", f"WITH {USAGE_SQL} SELECT count(*) AS calls, {_TOTALS} FROM usage")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_totals(usage(spark, sf_dir))


@query("f9_usage_since", f"WITH {USAGE_SQL} SELECT count(*) AS calls, {_TOTALS} FROM usage WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_totals(usage(spark, sf_dir), "2024-01-15 00:00:00")


@query("a2_heavy_files", f"WITH {CHUNKS_SQL} SELECT symbol_name AS path, CAST(sum(length(raw)) AS BIGINT) AS chars, CAST(ceil(sum(length(raw)) / 3.5) AS BIGINT) AS tokens FROM chunks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = chunks(spark, sf_dir).groupBy(F.col("symbol_name").alias("path")).agg(F.sum(F.length("raw")).cast("long").alias("chars"))
    return by.withColumn("tokens", F.ceil(F.col("chars") / 3.5).cast("long")).orderBy(F.desc("chars"), "path").limit(5)


@query("a3_store_statistics", f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks, count(DISTINCT symbol_name) AS files, CAST(sum(length(raw)) AS BIGINT) AS raw_chars, CAST(sum(length(substr(raw, 1, 200))) AS BIGINT) AS short_chars, round(CASE WHEN sum(length(raw)) > 0 THEN 1 - sum(length(substr(raw, 1, 200))) / sum(length(raw)) ELSE 0 END, 6) AS ratio FROM chunks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.substring("raw", 1, 200)
    out = chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count_distinct("symbol_name").alias("files"), F.sum(F.length("raw")).cast("long").alias("raw_chars"), F.sum(F.length(short)).cast("long").alias("short_chars"))
    return out.withColumn("ratio", F.round(F.when(F.col("raw_chars") > 0, 1 - F.col("short_chars") / F.col("raw_chars")).otherwise(0.0), 6))


@query("a4_counts", "SELECT (SELECT count(DISTINCT source) FROM documents) AS files, (SELECT count(*) FROM embeddings) AS vectors")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("files"))
    return files.crossJoin(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors")))


@query("a6_savings_by_kind", f"WITH {USAGE_SQL} SELECT tool_name AS ext, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS original, CAST(sum(saved_tokens) AS BIGINT) AS saved, round(sum(saved_tokens) / nullif(sum(input_tokens), 0), 6) AS ratio, round(sum(saved_tokens) / 1e6 * 3.0, 6) AS usd FROM usage GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = usage(spark, sf_dir).groupBy(F.col("tool_name").alias("ext")).agg(F.count("*").alias("n"), F.sum("input_tokens").alias("original"), F.sum("saved_tokens").alias("saved"))
    return by.withColumn("ratio", F.round(F.try_divide("saved", "original"), 6)).withColumn("usd", F.round(F.col("saved") / 1e6 * 3.0, 6)).orderBy(F.desc("saved"), "ext")


def burn_rate(log: DataFrame, prices: tuple[float, float] = (3.0, 15.0)) -> DataFrame:
    """Consumption over the span between the first and the last entry, a minute at least, in any order."""
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    base = log.agg(F.count("*").alias("api_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.greatest(seconds / 60e6, F.lit(1.0)).alias("m"))
    total = F.col("input_tokens") + F.col("output_tokens")
    cost = F.col("input_tokens") / 1e6 * prices[0] + F.col("output_tokens") / 1e6 * prices[1]
    return base.select("api_calls", "input_tokens", "output_tokens", total.alias("total"), round_half_up(total / F.col("m")).cast("long").alias("per_minute"), round_half_up(total / F.col("m") * 60).cast("long").alias("per_hour"), round_half_up(cost, 2).alias("cost_usd"), round_half_up(F.col("m"), 1).alias("minutes"))


BURN_SQL = f"""{USAGE_SQL}, b AS (SELECT count(*) AS api_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 1.0) AS m FROM usage),
  burn AS (SELECT api_calls, input_tokens, output_tokens, input_tokens + output_tokens AS total, CAST(floor((input_tokens + output_tokens) / m + 0.5) AS BIGINT) AS per_minute, CAST(floor((input_tokens + output_tokens) / m * 60 + 0.5) AS BIGINT) AS per_hour,
    floor((input_tokens / 1e6 * 3.0 + output_tokens / 1e6 * 15.0) * 100 + 0.5) / 100 AS cost_usd, floor(m * 10 + 0.5) / 10 AS minutes FROM b)"""


@query("a7_burn_rate", f"WITH {BURN_SQL} SELECT * FROM burn")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burn_rate(usage(spark, sf_dir))


def budget_forecast(burn: DataFrame, budget: int) -> DataFrame:
    used = F.col("total") / F.lit(float(budget))
    left = F.greatest(F.lit(0.0), (budget - F.col("total")) / F.nullif("per_minute", F.lit(0)))
    level = F.when(used >= 0.9, "critical").when(used >= 0.7, "warning").when(used >= 0.5, "info").otherwise("none")
    return burn.select(round_half_up(used, 3).alias("fraction"), round_half_up(left).cast("long").alias("minutes_left"), level.alias("alert"))


@query("a8_budget_forecast", f"WITH {BURN_SQL} SELECT floor(total / 20000000.0 * 1000 + 0.5) / 1000 AS fraction, CAST(floor(greatest(0.0, (20000000 - total) / nullif(per_minute, 0)) + 0.5) AS BIGINT) AS minutes_left, CASE WHEN total / 2e7 >= 0.9 THEN 'critical' WHEN total / 2e7 >= 0.7 THEN 'warning' WHEN total / 2e7 >= 0.5 THEN 'info' ELSE 'none' END AS alert FROM burn")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_forecast(burn_rate(usage(spark, sf_dir)), 20_000_000)


def latency_percentiles(samples: DataFrame, key: str, value: str, order: list[str], last: int = 200) -> DataFrame:
    """Over the last samples of each key: element floor(n p) of the sorted values, and the rounded mean."""
    recent = samples.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= last)
    lists = recent.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"), F.avg(value).alias("m"))
    at = lambda p: F.element_at("v", F.least(F.floor(F.size("v") * p) + 1, F.size("v")).cast("int"))
    return lists.select(key, F.size("v").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), round_half_up(F.col("m")).cast("long").alias("mean"))


@query("a9_latency_percentiles", """WITH r AS (SELECT event_type AS op, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
  l AS (SELECT op, list_sort(list(value)) AS v, avg(value) AS m FROM r WHERE r <= 200 GROUP BY 1)
  SELECT op, len(v) AS n, v[least(CAST(floor(len(v) * 0.5) AS BIGINT) + 1, len(v))] AS p50, v[least(CAST(floor(len(v) * 0.95) AS BIGINT) + 1, len(v))] AS p95, v[least(CAST(floor(len(v) * 0.99) AS BIGINT) + 1, len(v))] AS p99, CAST(floor(m + 0.5) AS BIGINT) AS mean FROM l""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), "value", "ts", "event_id")
    return latency_percentiles(e, "op", "value", ["ts", "event_id"])


@query("a10_interpolated_percentile", "SELECT event_type, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.8), 6) AS p80 FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.2).alias("p20"), p(0.5).alias("p50"), p(0.8).alias("p80"))


@query("a11_nearest_rank", "WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[greatest(1, CAST(ceil(len(v) * 0.5) AS BIGINT))] AS p50, v[greatest(1, CAST(ceil(len(v) * 0.95) AS BIGINT))] AS p95 FROM l")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Exact ranks by a distributed sort within each type: rank and count, no list of all values.
    w = Window.partitionBy("event_type")
    e = table(spark, sf_dir, "events").select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.greatest(F.lit(1), F.ceil(F.col("n") * p)), F.col("value")))
    return e.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts in [lo, hi); what lies beyond the last edge falls into the last bin, what lies below the first is left out."""
    bin_ = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        bin_ = F.when(F.col(column) >= edges[k], k).otherwise(bin_) if k == 0 else F.when(F.col(column) >= edges[k], k).otherwise(bin_)
    return values.select(bin_.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


@query("a12_histogram", "SELECT CASE WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 WHEN value >= 0 THEN 0 END AS bin, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "events"), "value", [0.0, 10.0, 50.0, 100.0, 1000.0])


def robust_z(rows: DataFrame, key: str, order: list[str], value: str, window: int = 2000, floor: float = 1e-6) -> DataFrame:
    """0.6745 (x - median) / max(MAD, floor) over the trailing rows of a key; medians are element floor(n/2)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    mid = lambda a: F.element_at(F.sort_array(a), (F.floor(F.size(a) / 2) + 1).cast("int"))
    seen = rows.withColumn("_l", F.collect_list(value).over(w)).withColumn("_m", mid(F.col("_l")))
    mad = mid(F.transform("_l", lambda x: F.abs(x - F.col("_m"))))
    return seen.withColumn("mad", mad).withColumn("z", 0.6745 * (F.col(value) - F.col("_m")) / F.greatest("mad", F.lit(floor))).withColumnRenamed("_m", "median").drop("_l")


@query("a13_robust_z", f"""WITH {CALLS_SQL}, l AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW) AS l FROM calls),
  m AS (SELECT *, list_sort(l)[CAST(floor(len(l) / 2) AS BIGINT) + 1] AS med FROM l), d AS (SELECT *, list_sort(list_transform(l, lambda x: abs(x - med)))[CAST(floor(len(l) / 2) AS BIGINT) + 1] AS mad FROM m)
  SELECT event_id, round(med, 6) AS median, round(mad, 6) AS mad, round(0.6745 * (value - med) / greatest(mad, 1e-6), 8) AS z FROM d""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust_z(calls(spark, sf_dir), "user_id", ["seq"], "value")
    return out.select("event_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("z", 8).alias("z"))


def entropy(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Shannon entropy (bits) of the items of each key."""
    n = rows.groupBy(key, item).agg(F.count("*").alias("n"))
    total = F.sum("n")
    # -sum(p log2 p) = log2(N) - sum(n log2 n) / N, in one pass.
    return n.groupBy(key).agg(F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy"))


@query("a14_entropy", "WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM n) SELECT lang, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy(table(spark, sf_dir, "documents"), "lang", "source")


def normalized_entropy(weights: DataFrame, column: str) -> DataFrame:
    """Entropy of positive weights relative to that of equal ones, from 0 to 1."""
    x, total = F.col(column), F.sum(column)
    h = F.log(total) - F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0)) / total
    return weights.agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(h, F.log(F.count("*").cast("double"))))), 6).alias("entropy"))


@query("a15_normalized_entropy", "WITH p AS (SELECT o_totalprice / sum(o_totalprice) OVER () AS p FROM orders) SELECT round(least(1.0, greatest(0.0, -sum(p * ln(p)) / ln(count(*)))), 6) AS entropy FROM p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_entropy(table(spark, sf_dir, "orders"), "o_totalprice")


def von_neumann(eigenvalues: Column) -> Column:
    """Entropy (bits excluded: natural logarithm) of the positive eigenvalues over their sum."""
    positive = F.filter(eigenvalues, lambda x: x > 1e-12)
    total = F.aggregate(positive, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(positive, F.lit(0.0), lambda s, x: s - (x / total) * F.log(x / total))


@query("a16_spectral_entropy", "WITH v AS (SELECT [0.0, 0.059581, 0.161211, 0.228693, 0.360901] AS l), p AS (SELECT unnest(list_filter(l, lambda x: x > 1e-12)) AS x FROM v), q AS (SELECT x / sum(x) OVER () AS p FROM p) SELECT round(-sum(p * ln(p)), 6) AS entropy FROM q")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1).select(F.array(*map(F.lit, [0.0, 0.059581, 0.161211, 0.228693, 0.360901])).alias("l"))
    return one.select(F.round(von_neumann(F.col("l")), 6).alias("entropy"))


@query("a17_first_error_by_user", "SELECT user_id, count(*) AS errors, min_by(props, event_id) AS first_props FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"), F.min_by("props", "event_id").alias("first_props"))


@query("a19_degrees", "SELECT s_nationkey AS dst, count(*) AS in_degree, count(DISTINCT c_nationkey) AS imported_by FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = j.where("c_nationkey <> s_nationkey").groupBy(F.col("s_nationkey").alias("dst"), "c_nationkey").agg(F.count("*").alias("n"))
    return pairs.groupBy("dst").agg(F.sum("n").alias("in_degree"), F.count("*").alias("imported_by"))


@query("a20_sorted_sets", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("a21_rollup", f"WITH {CHUNKS_SQL} SELECT split_part(path, '/', 2) AS dir, count(CASE WHEN length(raw) >= 2000 THEN 1 END) AS critical, count(CASE WHEN length(raw) < 2000 THEN 1 END) AS hidden, coalesce(array_to_string(list_sort(list(CAST(id AS VARCHAR)) FILTER (WHERE length(raw) >= 20000)), ','), '') AS largest FROM chunks GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("raw")
    return chunks(spark, sf_dir).groupBy(F.element_at(F.split("path", "/"), 2).alias("dir")).agg(F.count_if(n >= 2000).alias("critical"), F.count_if(n < 2000).alias("hidden"), F.array_join(F.sort_array(F.collect_list(F.when(n >= 20000, F.col("id").cast("string")))), ",").alias("largest"))


def weighted_index(scores: DataFrame) -> DataFrame:
    """Ten times the weighted mean of the active scores, one decimal; 5.0 without weight."""
    return scores.agg(F.coalesce(round_half_up(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")) * 10, 1), F.lit(5.0)).alias("index"))


@query("a22_weighted_index", "SELECT coalesce(floor(sum(score * weight) / nullif(sum(weight), 0) * 100 + 0.5) / 10, 5.0) AS \"index\" FROM (SELECT s_acctbal / 10000 AS score, CASE WHEN s_acctbal > 0 THEN 0.25 ELSE 0 END AS weight FROM supplier)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_index(table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 10000).alias("score"), F.when(F.col("s_acctbal") > 0, 0.25).otherwise(0.0).alias("weight")))


def bucket_score(x: Column, t0: float, t1: float, t2: float) -> Column:
    """Piecewise linear, higher is better; t0 > t1 > t2."""
    return F.when(x >= t0, 1.0).when(x >= t1, 0.7 + 0.3 * ((x - t1) / (t0 - t1))).when(x >= t2, 0.4 + 0.3 * ((x - t2) / (t1 - t2))).otherwise(F.greatest(F.lit(0.1), 0.4 - 0.3 * ((t2 - x) / (t1 - t2))))


def bucket_score_inverse(x: Column, t0: float, t1: float, t2: float) -> Column:
    """Piecewise linear, lower is better; t0 < t1 < t2."""
    return F.when(x <= t0, 1.0).when(x <= t1, 1.0 - 0.3 * ((x - t0) / (t1 - t0))).when(x <= t2, 0.7 - 0.3 * ((x - t1) / (t2 - t1))).otherwise(F.greatest(F.lit(0.1), 0.4 - 0.3 * ((x - t2) / (t2 - t1))))


def score_label(x: Column) -> Column:
    return F.when(x >= 0.9, "HEALTHY").when(x >= 0.7, "GOOD").when(x >= 0.4, "FAIR").when(x >= 0.2, "POOR").otherwise("CRITICAL")


@query("c15_bucket_scores", """WITH x AS (SELECT p_partkey, p_size / 50.0 AS x FROM part), s AS (SELECT p_partkey, CASE WHEN x >= 0.9 THEN 1.0 WHEN x >= 0.7 THEN 0.7 + 0.3 * ((x - 0.7) / (0.9 - 0.7)) WHEN x >= 0.4 THEN 0.4 + 0.3 * ((x - 0.4) / (0.7 - 0.4)) ELSE greatest(0.1, 0.4 - 0.3 * ((0.4 - x) / (0.7 - 0.4))) END AS up,
   CASE WHEN x <= 0.05 THEN 1.0 WHEN x <= 0.15 THEN 1.0 - 0.3 * ((x - 0.05) / (0.15 - 0.05)) WHEN x <= 0.5 THEN 0.7 - 0.3 * ((x - 0.15) / (0.5 - 0.15)) ELSE greatest(0.1, 0.4 - 0.3 * ((x - 0.5) / (0.5 - 0.15))) END AS down FROM x)
   SELECT p_partkey, round(CAST(up AS DOUBLE), 6) AS up, round(CAST(down AS DOUBLE), 6) AS down FROM s""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size") / F.lit(50.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(bucket_score(x, 0.9, 0.7, 0.4), 6).alias("up"), F.round(bucket_score_inverse(x, 0.05, 0.15, 0.5), 6).alias("down"))


@query("c14_static_savings", "SELECT doc_id, CAST(floor(n_chars / 3.5 * CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.75 ELSE 0.92 END + 0.5) AS BIGINT) AS saved FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "fr", 0.75).otherwise(0.92)
    return table(spark, sf_dir, "documents").select("doc_id", round_half_up(F.col("n_chars") / 3.5 * share).cast("long").alias("saved"))
