"""Graph analytics as DataFrame loops: PageRank, tiers, reachability, components, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.order import numbered, values_at
from quarry.plans.stored import cut
from quarry.registry import query
from quarry.sources.tables import TRADE_SQL, table, trade

DAMPING, ITERATIONS = 0.85, 20


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, cut_every: int = 5) -> DataFrame:
    """node, pr from ``vertices`` (node) and distinct ``edges`` (src, dst).

    A fixed number of iterations from the uniform vector; the mass of vertices without
    out-edges spreads over all; the result is divided by its maximum.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = cut(edges.join(out, "src").select("src", "dst", (1 / F.col("out")).alias("share")))
    total = F.broadcast(vertices.agg(F.count("*").cast("double").alias("n")))
    base = cut(vertices.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("out").isNull().alias("sink")).crossJoin(total))
    ranks = base.select("node", "sink", "n", (1 / F.col("n")).alias("pr"))
    for k in range(1, iterations + 1):
        leak = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("pr"))), F.lit(0.0)).alias("leak")))
        got = links.join(ranks.select(F.col("node").alias("src"), "pr"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pr") * F.col("share")).alias("got"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("leak") / F.col("n"))
        ranks = base.join(got, "node", "left").crossJoin(leak).select("node", "sink", "n", new.alias("pr"))
        if k % cut_every == 0:
            ranks = cut(ranks)
    top = F.broadcast(ranks.agg(F.max("pr").alias("top")))
    return ranks.crossJoin(top).select("node", (F.col("pr") / F.col("top")).alias("pr"))


def tier_shares(n: int) -> tuple[float, float]:
    """Percentiles of the core and logic tiers; they grow with the size of the graph."""
    import math

    s = math.log10(max(10, n) / 300)
    return min(0.995, max(0.85, 0.91 + 0.05 * s)), min(0.80, max(0.50, 0.60 + 0.10 * s))


def tiers(ranks: DataFrame, in_degree: DataFrame) -> DataFrame:
    """node, pr, tier: cuts at element floor(n q) of the sorted ranks; core and logic need an in-edge."""
    n = ranks.count()
    if not n:
        return ranks.select("node", "pr", F.lit("leaf").alias("tier"))
    cuts = [c or 0.0 for c in values_at(ranks, "pr", "node", [int(n * q) for q in tier_shares(n)])]
    met = ranks.join(in_degree, "node", "left")
    linked = F.coalesce("in_degree", F.lit(0)) > 0
    return met.select("node", "pr", F.when(linked & (F.col("pr") >= cuts[0]), "core").when(linked & (F.col("pr") >= cuts[1]), "logic").otherwise("leaf").alias("tier"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that can be reached from ``roots`` (node), the roots included, one hop a round."""
    seen = frontier = cut(roots.select("node").distinct())
    while True:
        found = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(found)
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node): label propagation with pointer jumping."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = vertices.select("node", F.col("node").alias("component"))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("new"), "component")
        up = least.select(F.col("node").alias("new"), F.col("new").alias("top"))
        labels = cut(least.join(up, "new").select("node", F.least("new", "top").alias("component"), F.col("component").alias("was")))
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def circuit_rank(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: undirected edges E without repeats and loops, vertices V, components C, and E - V + C."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    c = components(vertices, e).agg(F.count("*").alias("v"), F.count_distinct("component").alias("c"))
    return e.agg(F.count("*").alias("e")).crossJoin(c).select("e", "v", "c", (F.col("e") - F.col("v") + F.col("c")).alias("rank"))


def ego(edges: DataFrame, center: int) -> DataFrame:
    """Edges at one node, either way."""
    return edges.where((F.col("src") == center) | (F.col("dst") == center)).select("src", "dst").distinct()


def first_crown(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Edges among the core nodes and their neighbours."""
    c = F.broadcast(core.select("node")) if core.count() <= 10_000 else core.select("node")
    out = edges.join(c.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))
    into = edges.join(c.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"))
    nodes = cut(out.unionByName(into).unionByName(core.select("node")).distinct())
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return v, cut(trade(spark, sf_dir).select("src", "dst"))


_V = "v AS (SELECT n_nationkey AS node FROM nation), e AS MATERIALIZED (SELECT src, dst FROM trade)"
_OUT = "o AS MATERIALIZED (SELECT node, (SELECT count(*) FROM e WHERE src = node) AS out, (SELECT count(*) FROM v) AS n FROM v)"
_STEPS = ["r0 AS MATERIALIZED (SELECT node, 1.0 / n AS pr FROM o)"] + [
    f"r{k} AS MATERIALIZED (SELECT o.node, {1 - DAMPING} / o.n + {DAMPING} * (coalesce((SELECT sum(p.pr / q.out) FROM e JOIN r{k - 1} p ON p.node = e.src JOIN o q ON q.node = e.src WHERE e.dst = o.node), 0) + coalesce((SELECT sum(p.pr) FROM r{k - 1} p JOIN o q ON q.node = p.node WHERE q.out = 0), 0) / o.n) AS pr FROM o)"
    for k in range(1, ITERATIONS + 1)
]
PAGERANK_SQL = f"WITH {TRADE_SQL}, {_V}, {_OUT}, {', '.join(_STEPS)}, pr AS (SELECT node, pr / (SELECT max(pr) FROM r{ITERATIONS}) AS pr FROM r{ITERATIONS})"


@query("g2_pagerank", f"{PAGERANK_SQL} SELECT node, round(pr, 6) AS pr FROM pr")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(*_graph(spark, sf_dir)).select("node", F.round("pr", 6).alias("pr"))


@query("g3_tiers", f"{PAGERANK_SQL}, s AS (SELECT list_sort(list(pr)) AS l, count(*) AS n FROM pr), x AS (SELECT l, n, log10(greatest(10, n) / 300.0) AS s FROM s), c AS (SELECT l[CAST(floor(n * least(0.995, greatest(0.85, 0.91 + 0.05 * s))) AS BIGINT) + 1] AS c1, l[CAST(floor(n * least(0.80, greatest(0.50, 0.60 + 0.10 * s))) AS BIGINT) + 1] AS c2 FROM x) SELECT node, CASE WHEN (SELECT count(*) FROM e WHERE dst = node) > 0 AND pr >= c1 - 1e-12 THEN 'core' WHEN (SELECT count(*) FROM e WHERE dst = node) > 0 AND pr >= c2 - 1e-12 THEN 'logic' ELSE 'leaf' END AS tier FROM pr, c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _graph(spark, sf_dir)
    ranks = cut(pagerank(v, e))
    return tiers(ranks, e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))).select("node", "tier")


@query("g6_reachable", f"WITH RECURSIVE {TRADE_SQL}, e AS (SELECT src, dst FROM trade), r AS (SELECT 3 AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(trade(spark, sf_dir).select("src", "dst"))
    return reachable(e, spark.createDataFrame([(3,)], "node int"))


_CIRCUIT = "e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade), v AS (SELECT n_nationkey AS node FROM nation), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT node, node AS hit FROM v UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.hit)"


@query("g7_circuit_rank", f"WITH RECURSIVE {TRADE_SQL}, {_CIRCUIT}, c AS (SELECT node, min(hit) AS c FROM r GROUP BY 1), k AS (SELECT (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM v) AS v, (SELECT count(DISTINCT c) FROM c) AS c) SELECT e, v, c, e - v + c AS rank FROM k")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return circuit_rank(v, cut(trade(spark, sf_dir).select("src", "dst")))


@query("g7_components", f"WITH RECURSIVE {TRADE_SQL}, {_CIRCUIT} SELECT node, min(hit) AS component FROM r GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return components(v, cut(trade(spark, sf_dir).select("src", "dst")))


@query("j20_ego_graph", f"WITH {TRADE_SQL} SELECT DISTINCT src, dst FROM trade WHERE src = 3 OR dst = 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego(trade(spark, sf_dir), 3)


@query("j21_first_crown", f"WITH {TRADE_SQL}, core AS (SELECT * FROM (VALUES (3), (5)) x(node)), n AS (SELECT node FROM core UNION SELECT dst FROM trade JOIN core ON src = node UNION SELECT src FROM trade JOIN core ON dst = node) SELECT src, dst FROM trade WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_crown(_graph(spark, sf_dir)[1], spark.createDataFrame([(3,), (5,)], "node int"))


@query("j10_inverted_graph", f"WITH {TRADE_SQL} SELECT dst AS src, src AS dst FROM trade")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query("g13_dependents", f"WITH {TRADE_SQL} SELECT src FROM trade WHERE dst = 7")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).where("dst = 7").select("src")


@query("g12_node_index", f"WITH {TRADE_SQL}, n AS (SELECT src AS node FROM trade UNION SELECT dst FROM trade) SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(trade(spark, sf_dir))
    nodes = t.select(F.col("src").alias("node")).unionByName(t.select(F.col("dst").alias("node"))).distinct()
    return numbered(nodes, ["node"], "idx").select("node", "idx")


@query("g12_document_index", "SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) - 1 AS idx FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in the order of their texts; copies go by their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("text"))
    return numbered(docs, ["text", "doc_id"], "idx").select("doc_id", "idx")


@query("page_links", "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM h GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.groupBy("href", "page_id").agg(F.count("*").alias("n")).groupBy("href").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
