"""Joins, set operations, upserts and deletes, and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import identifiers
from quarry.registry import query
from quarry.sources.tables import CALLS_SQL, CHUNKS_SQL, calls, chunks, table


def last_writer_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert by key: the row with the greatest ``order`` of each key.  Aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


@query("k3_upsert", "SELECT user_id, event_type, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_writer_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], "event_id")


@query("k4_delete_by_key", f"WITH {CHUNKS_SQL} SELECT id, path FROM chunks WHERE symbol_name NOT IN ('src1', 'src2')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src2",)], "symbol_name string")
    return chunks(spark, sf_dir).join(F.broadcast(gone), "symbol_name", "left_anti").select("id", "path")


@query("k5_delete_by_composite_key", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND l_linenumber = 1)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(gone, ["l_orderkey", "l_linenumber"], "left_anti")


@query("j1_hydrate", f"WITH {CHUNKS_SQL}, ids AS (SELECT * FROM (VALUES (3), (17), (17), (999999999)) v(id)) SELECT id, path, node_type FROM ids JOIN chunks USING (id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(3,), (17,), (17,), (999999999,)], "id long")
    return chunks(spark, sf_dir).select("id", "path", "node_type").join(F.broadcast(ids), "id")


@query("j2_full_outer_fusion", "SELECT coalesce(d.doc_id, e.vec_id) AS id, round(coalesce(1.0 / (10 + d.doc_id), 0) + coalesce(1.0 / (10 + e.vec_id), 0), 8) AS score FROM labels d FULL JOIN embeddings e ON d.doc_id = e.vec_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and vectors, two lists that overlap in part, by their ids as ranks."""
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("in_d"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("in_e"))
    part = lambda c: F.when(F.col(c), 1 / (10 + F.col("id"))).otherwise(0.0)
    return d.join(e, "id", "full_outer").select("id", F.round(part("in_d") + part("in_e"), 8).alias("score"))


@query("j6_left_with_defaults", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("j7_exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_large FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_large", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left").select("c_custkey", F.coalesce("has_large", F.lit(False)).alias("has_large"))


def resolve_first(wanted: DataFrame, rules: list, lookup: DataFrame) -> DataFrame:
    """Ordered lookup: each rule turns ``key`` into a candidate; the first candidate in ``lookup`` (key, target) wins."""
    candidates = F.array(*[F.struct(F.lit(k).alias("priority"), rule(F.col("key")).alias("candidate")) for k, rule in enumerate(rules)])
    rows = wanted.select("id", F.explode(candidates).alias("c")).select("id", "c.priority", "c.candidate")
    met = rows.join(lookup.withColumnRenamed("key", "candidate"), "candidate")
    return met.groupBy("id").agg(F.min(F.struct("priority", "target")).alias("m")).select("id", "m.target", F.col("m.priority").cast("int").alias("rule"))


@query("j8_ordered_lookup", """WITH look AS (SELECT p_brand AS key, max(p_partkey) AS target FROM part GROUP BY 1), w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_brand || '.js' ELSE './' || p_brand || '/index' END AS key FROM part),
  c AS (SELECT id, 0 AS priority, key AS cand FROM w UNION ALL SELECT id, 1, regexp_replace(key, '\\.js$', '') FROM w UNION ALL SELECT id, 2, regexp_replace(regexp_replace(key, '^\\./', ''), '/index$', '') FROM w)
  SELECT id, min_by(target, priority) AS target, CAST(min(priority) AS INTEGER) AS rule FROM c JOIN look ON cand = look.key GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    wanted = p.select(F.col("p_partkey").alias("id"), F.when(kind == 0, F.col("p_brand")).when(kind == 1, F.concat("p_brand", F.lit(".js"))).otherwise(F.concat(F.lit("./"), "p_brand", F.lit("/index"))).alias("key"))
    lookup = p.groupBy(F.col("p_brand").alias("key")).agg(F.max("p_partkey").alias("target"))
    rules = [lambda k: k, lambda k: F.regexp_replace(k, r"\.js$", ""), lambda k: F.regexp_replace(F.regexp_replace(k, r"^\./", ""), "/index$", "")]
    return resolve_first(wanted, rules, lookup)


@query("j11_orphans", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey").join(used, "p_partkey", "left_anti")


def ghosts(exports: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, ident) of ``exports`` that no *other* path uses.

    Needs no theta join: an identifier is used elsewhere if it has two paths, or one that
    is not this one.
    """
    paths = uses.groupBy("ident").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    met = exports.join(paths, "ident", "left")
    elsewhere = F.coalesce((F.col("lo") != F.col("path")) | (F.col("hi") != F.col("path")), F.lit(False))
    return met.where(~elsewhere).select("path", "ident")


@query("j12_ghost_exports", """WITH i AS (SELECT DISTINCT source AS path, unnest(regexp_extract_all(text, '[a-zA-Z_$][a-zA-Z0-9_$]*')) AS ident FROM documents) SELECT path, ident FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.ident = i.ident AND j.path <> i.path)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.explode(identifiers(F.col("text"))).alias("ident")).distinct()
    return ghosts(i, i)


@query("j13_note_validity", "SELECT e.event_id, CASE WHEN o.user_id IS NULL THEN 'gone' WHEN e.value = o.value OR lower(e.props) LIKE 'assert%' THEN 'valid' ELSE 'stale' END AS state FROM (SELECT * FROM events WHERE event_id % 2 = 0) e LEFT JOIN (SELECT user_id, event_type, max_by(value, event_id) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.event_type = o.event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.where("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("now")).withColumn("known", F.lit(True))
    met = e.where("event_id % 2 = 0").join(now, ["user_id", "event_type"], "left")
    return met.select("event_id", F.when(F.col("known").isNull(), "gone").when((F.col("value") == F.col("now")) | F.lower("props").startswith("assert"), "valid").otherwise("stale").alias("state"))


def overlaps(rows: DataFrame, key: str, bucket: float) -> DataFrame:
    """Pairs a < b of intervals [lo, hi) of one key that overlap, by buckets of the line.

    A pair is found in the bucket where the later of both begins, so it is found once and
    no join is a nested loop.
    """
    first, last = F.floor(F.col("lo") / bucket).cast("long"), F.floor(F.col("hi") / bucket).cast("long")
    spread = rows.withColumn("b", F.explode(F.sequence(first, last)))
    a, b = spread.alias("a"), spread.alias("c")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"c.{key}")) & (F.col("a.b") == F.col("c.b")) & (F.col("a.id") < F.col("c.id")) & (F.col("a.lo") < F.col("c.hi")) & (F.col("c.lo") < F.col("a.hi")))
    return met.where(F.col("a.b") == F.floor(F.greatest("a.lo", "c.lo") / bucket).cast("long")).select(F.col(f"a.{key}").alias(key), F.col("a.id").alias("a"), F.col("c.id").alias("b"))


@query("j14_interval_overlap", "WITH i AS (SELECT user_id, event_id AS id, epoch_us(ts) / 1e6 AS lo, epoch_us(ts) / 1e6 + value * 100 + 1 AS hi FROM events) SELECT x.user_id, x.id AS a, y.id AS b FROM i x JOIN i y ON x.user_id = y.user_id AND x.id < y.id AND x.lo < y.hi AND y.lo < x.hi")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), start.alias("lo"), (start + F.col("value") * 100 + 1).alias("hi"))
    return overlaps(rows, "user_id", 36000.0)


def contract_regressions(pre: DataFrame, post: DataFrame) -> DataFrame:
    """file, symbol: contracts that got worse, lost their type, or are new and bad; removed symbols are no regression."""
    a = pre.select("file", "symbol", F.col("score").alias("old_score"), F.col("kind").alias("old_kind"))
    met = a.join(post, ["file", "symbol"], "full_outer")
    verdict = F.when(F.col("score").isNull(), None).when(F.col("old_score").isNull(), F.when(F.col("score") > 0, "new")).when(F.col("score") > F.col("old_score"), "worse").when((F.col("old_kind") != "any") & (F.col("kind") == "any"), "untyped")
    return met.withColumn("verdict", verdict).where("verdict is not null").select("file", "symbol", "old_score", "score", "verdict")


@query("j15_contract_regressions", """WITH o AS (SELECT o_custkey AS file, o_orderpriority AS symbol, year(o_orderdate) <= 1995 AS pre, count(*) AS score, CASE WHEN count(*) % 2 = 0 THEN 'any' ELSE 'typed' END AS kind FROM orders GROUP BY 1, 2, 3),
  m AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.symbol, b.symbol) AS symbol, a.score AS old_score, b.score AS score, a.kind AS ok, b.kind AS nk FROM (SELECT * FROM o WHERE pre) a FULL JOIN (SELECT * FROM o WHERE NOT pre) b ON a.file = b.file AND a.symbol = b.symbol)
  SELECT file, symbol, old_score, score, CASE WHEN old_score IS NULL THEN 'new' WHEN score > old_score THEN 'worse' ELSE 'untyped' END AS verdict FROM m WHERE score IS NOT NULL AND (old_score IS NULL AND score > 0 OR score > old_score OR ok <> 'any' AND nk = 'any')""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("symbol"), (F.year("o_orderdate") <= 1995).alias("pre")).agg(F.count("*").alias("score"))
    o = o.withColumn("kind", F.when(F.col("score") % 2 == 0, "any").otherwise("typed"))
    return contract_regressions(o.where("pre").drop("pre"), o.where("not pre").drop("pre"))


@query("j16_changed_signatures", "SELECT a.user_id AS symbol, a.v AS old_sig, b.v AS new_sig FROM (SELECT user_id, max_by(event_type, event_id) AS v FROM events WHERE event_id < 5000 GROUP BY 1) a JOIN (SELECT user_id, max_by(event_type, event_id) AS v FROM events WHERE event_id >= 5000 GROUP BY 1) b USING (user_id) WHERE a.v <> b.v")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = lambda c, n: e.where(c).groupBy(F.col("user_id").alias("symbol")).agg(F.max_by("event_type", "event_id").alias(n))
    return last("event_id < 5000", "old_sig").join(last("event_id >= 5000", "new_sig"), "symbol").where("old_sig <> new_sig")


def staleness(old: DataFrame, new: DataFrame, key: str, tolerance: float) -> DataFrame:
    """deleted, changed or new keys between two snapshots of (key, stamp)."""
    met = old.select(key, F.col("stamp").alias("was")).join(new, key, "full_outer")
    state = F.when(F.col("stamp").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.abs(F.col("stamp") - F.col("was")) > tolerance, "changed")
    return met.select(key, state.alias("state")).where("state is not null")


@query("j17_staleness", "WITH a AS (SELECT s_suppkey AS k, s_acctbal AS s FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_suppkey AS k, s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0.5 END AS s FROM supplier WHERE s_suppkey % 7 <> 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'deleted' WHEN a.k IS NULL THEN 'new' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR abs(a.s - b.s) > 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    a = s.where(k % 5 != 0).select(k.alias("k"), F.col("s_acctbal").alias("stamp"))
    b = s.where(k % 7 != 0).select(k.alias("k"), (F.col("s_acctbal") + F.when(k % 3 == 0, 2.0).otherwise(0.5)).alias("stamp"))
    return staleness(a, b, "k", 1.0)


@query("j18_unread_heavy", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(read, "o_orderkey", "left_anti").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


# What a test's name has after that of the file it tests, and how it imports.
TEST_NAME = r"\.(?:test|spec)\."
TEST_IMPORT = r"(?:from\s*|require\s*\(|import\s*\(|import\s+)['\"`]([^'\"`]*)['\"`]"
HEAD_LINES = 50


def whole_parts(text: Column) -> Column:
    """The pieces of a text that a pattern with word boundaries at both its ends can match: runs of words and what lies between them."""
    pieces = F.regexp_extract_all(F.regexp_replace(text, r"^\W+|\W+$", ""), F.lit(r"\w+|\W+"), F.lit(0))
    to = lambda i: F.transform(F.sequence(i, F.size(pieces)), lambda j: F.array_join(F.slice(pieces, i, j - i + 1), ""))
    return F.when(F.size(pieces) > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(pieces)), to)))).otherwise(F.array().cast("array<string>"))


def tested(files: DataFrame, tests: DataFrame) -> DataFrame:
    """path of the ``files`` (path) that one of the ``tests`` (path, code) has: by its name, or by an import in its first lines.

    A test names a file if its own name goes on after the file's with .test. or .spec.; it imports a file if a quoted name
    in its first 50 lines, comments left out, holds the file's name as a whole.  Each test gives
    the few names that it can have; they meet the files in a join, whatever the number of either.
    """
    base = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\.(?:ts|tsx|js|jsx)$", "")
    own = F.regexp_extract("path", r"[^/]*$", 0)
    # The name before each of the marks that it has.
    marks = F.transform(F.sequence(F.lit(1), F.regexp_count(own, F.lit(TEST_NAME))), lambda k: F.array_join(F.slice(F.split(own, TEST_NAME), 1, k), "."))
    named = tests.where(own.rlike(TEST_NAME)).select(F.explode(marks).alias("base"))
    head = F.array_join(F.slice(F.split(F.coalesce("code", F.lit("")), "\n", -1), 1, HEAD_LINES), "\n")
    clean = F.regexp_replace(F.regexp_replace(head, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    imported = tests.select(F.explode(F.regexp_extract_all(clean, F.lit(TEST_IMPORT), F.lit(1))).alias("name")).select(F.explode(whole_parts(F.col("name"))).alias("base"))
    return files.withColumn("base", base).join(named.unionByName(imported).distinct(), "base", "left_semi").select("path")


@query("j19_test_coverage", "SELECT 'src/n' || c_nationkey || '/c' || c_custkey || '.ts' AS path FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey = c_custkey) OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey + 2 = c_custkey)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, orders as tests: of one by name, of another by an import; imports in comments and far down do not count."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    text = lambda k: k.cast("string")
    files = c.select(F.concat(F.lit("src/n"), text(F.col("c_nationkey")), F.lit("/c"), text(F.col("c_custkey")), F.lit(".ts")).alias("path"))
    kind, key, who = F.col("o_orderkey") % 3, F.col("o_orderkey"), F.col("o_custkey")
    path = F.when(kind == 0, F.concat(F.lit("test/c"), text(who), F.lit(".spec.ts"))).otherwise(F.concat(F.lit("test/t"), text(key), F.lit(".test.ts")))
    real = F.concat(F.lit("// from './c"), text(who + 1), F.lit("'\nimport {\n  x,\n} from '../src/c"), text(who + 2), F.lit(".js';\n"))
    far = F.concat(F.lit("/* require('./c"), text(who), F.lit("') */\n"), F.lit("\n" * HEAD_LINES), F.lit("import './c"), text(who + 3), F.lit("';"))
    return tested(files, o.select(path.alias("path"), F.when(kind == 1, real).when(kind == 2, far).otherwise("").alias("code")))


@query("j22_direction", "WITH u AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), d AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity < 2) SELECT s_suppkey, CASE WHEN u.k IS NOT NULL THEN 'upstream' WHEN d.k IS NOT NULL THEN 'downstream' ELSE 'unrelated' END AS zone FROM supplier LEFT JOIN u ON u.k = s_suppkey LEFT JOIN d ON d.k = s_suppkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both flags from one pass over the large side.
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(F.col("l_quantity") > 49).alias("u"), F.max(F.col("l_quantity") < 2).alias("d"))
    met = table(spark, sf_dir, "supplier").select("s_suppkey").join(flags, "s_suppkey", "left")
    return met.select("s_suppkey", F.when(F.col("u"), "upstream").when(F.col("d"), "downstream").otherwise("unrelated").alias("zone"))


@query("j23_debt_payment", "SELECT a.c_custkey, CASE WHEN b.o_custkey IS NULL THEN 'paid (removed)' WHEN trim(a.c_mktsegment) = trim(b.p) THEN 'paid' ELSE 'open' END AS state FROM customer a LEFT JOIN (SELECT o_custkey, CASE WHEN count(*) % 2 = 0 THEN 'BUILDING ' ELSE max(o_orderpriority) END AS p FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.count("*") % 2 == 0, "BUILDING ").otherwise(F.max("o_orderpriority")).alias("p"))
    met = table(spark, sf_dir, "customer").join(now, "c_custkey", "left")
    return met.select("c_custkey", F.when(F.col("p").isNull(), "paid (removed)").when(F.trim("c_mktsegment") == F.trim("p"), "paid").otherwise("open").alias("state"))


@query("j24_candidates_or_all", "WITH c AS (SELECT doc_id FROM documents WHERE contains(text, 'no such symbol anywhere')) SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM c) OR NOT EXISTS (SELECT 1 FROM c)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    some = d.where(F.col("text").contains("no such symbol anywhere")).select("doc_id")
    return d.select("doc_id") if some.isEmpty() else d.join(some, "doc_id", "left_semi").select("doc_id")


@query("j25_sign_alignment", "WITH a AS (SELECT l_suppkey AS k, year(l_shipdate) AS y, sum(l_quantity) - 700 AS v FROM lineitem GROUP BY 1, 2) SELECT n.y, CASE WHEN sum(n.v * p.v) < 0 THEN -1 ELSE 1 END AS sign FROM a n JOIN a p ON n.k = p.k AND n.y = p.y + 1 GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").cast("long").alias("y")).agg((F.sum("l_quantity") - 700).alias("v"))
    before = F.lag(F.struct("y", "v")).over(Window.partitionBy("k").orderBy("y"))
    met = a.withColumn("p", before).where(F.col("p.y") == F.col("y") - 1)
    return met.groupBy("y").agg(F.when(F.sum(F.col("v") * F.col("p.v")) < 0, -1).otherwise(1).alias("sign"))


@query("j26_arrays_overlap", "WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_totalprice > 250000 GROUP BY 1) SELECT o_custkey, list_has_any(p, ['1-URGENT', '2-HIGH']) AS hot FROM a")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_totalprice > 250000").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return a.select("o_custkey", F.arrays_overlap("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("hot"))


def new_findings(current: DataFrame, baseline: DataFrame, key: str, order: str) -> DataFrame:
    """Multiset difference: the later rows of a key beyond as many as the baseline has."""
    had = baseline.groupBy(key).agg(F.count("*").alias("_had"))
    ranked = current.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.join(had, key, "left").where(F.col("_r") > F.coalesce("_had", F.lit(0))).drop("_r", "_had")


_PRINT = "sha256(user_id || '|' || event_type)"


@query("u2_multiset_difference", f"WITH b AS (SELECT {_PRINT} AS k, count(*) AS had FROM events WHERE event_id < 5000 GROUP BY 1), c AS (SELECT event_id, {_PRINT} AS k, row_number() OVER (PARTITION BY {_PRINT} ORDER BY event_id) AS r FROM events WHERE event_id >= 5000) SELECT event_id, c.k AS fingerprint FROM c LEFT JOIN b USING (k) WHERE r > coalesce(had, 0)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("fingerprint"))
    return new_findings(e.where("event_id >= 5000"), e.where("event_id < 5000"), "fingerprint", "event_id")


@query("u3_distinct_last_wins", "SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_writer_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("u4_distinct_first_wins", "SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@query("u5_edge_dedup", "SELECT least(l_suppkey, l_partkey % 100) AS u, greatest(l_suppkey, l_partkey % 100) AS v, max(l_discount) AS weight FROM lineitem WHERE l_suppkey <> l_partkey % 100 GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("l_partkey") % 100
    e = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") != b)
    return e.groupBy(F.least("l_suppkey", b).alias("u"), F.greatest("l_suppkey", b).alias("v")).agg(F.max("l_discount").alias("weight"))


@query("u6_list_equality", "WITH s AS (SELECT o_custkey, year(o_orderdate) % 2 AS h, list_sort(list(DISTINCT o_orderpriority)) AS l FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.l = b.l AS same FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.h = 0 AND b.h = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda h: F.sort_array(F.collect_set(F.when(F.year("o_orderdate") % 2 == h, F.col("o_orderpriority"))))
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(side(0).alias("a"), side(1).alias("b")).where("size(a) > 0 and size(b) > 0")
    return s.select("o_custkey", (F.col("a") == F.col("b")).alias("same"))


@query("u8_dependents_minus_edited", "WITH edited AS (SELECT * FROM (VALUES (1), (2), (3)) v(k)), d AS (SELECT DISTINCT c_nationkey AS k FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT k FROM edited)), r AS (SELECT k FROM d WHERE k NOT IN (SELECT k FROM edited)) SELECT k FROM r WHERE (SELECT count(*) FROM r) <= 50")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    edited = [1, 2, 3]
    lines = t("lineitem").where(F.col("l_suppkey").isin(edited)).select(F.col("l_orderkey").alias("o_orderkey"))
    d = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey", "left_semi").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("k")), "c_custkey").select("k").distinct()
    rest = d.where(~F.col("k").isin(edited))
    total = rest.agg(F.count("*").alias("n"))
    return rest.crossJoin(F.broadcast(total)).where("n <= 50").select("k")


@query("u7_intersection", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'O'").select("o_custkey"), "o_custkey", "left_semi")


@query("o5_top_per_group", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", r.alias("rank")).where("rank <= 3")


@query("o6_severity_sort", "SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS severity FROM events ORDER BY severity, event_id LIMIT 100")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, sf_dir, "events").select("event_id", severity.alias("severity")).orderBy("severity", "event_id").limit(100)


@query("o8_limit_clamp", "SELECT p_partkey, least(greatest(p_size, 1), 20) AS clamped FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.greatest("p_size", F.lit(1)), F.lit(20)).alias("clamped"))


@query("o9_line_truncation", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], chr(10)) || chr(10) || '... ' || (len(l) - 5) || ' lines truncated' ELSE array_to_string(l, chr(10)) END AS text FROM l")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    cut = F.concat(F.array_join(F.slice("l", 1, 5), "\n"), F.lit("\n... "), (F.size("l") - 5).cast("string"), F.lit(" lines truncated"))
    return l.select("doc_id", F.when(F.size("l") > 5, cut).otherwise(F.array_join("l", "\n")).alias("text"))


@query("s8_point_scan", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id = 42").select("doc_id", "lang", "source")


@query("c18_next_id", "SELECT 'pin-' || lpad(CAST(max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) + 1 AS VARCHAR), 6, '0') AS next_id FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.max(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long")) + 1
    return table(spark, sf_dir, "customer").agg(F.concat(F.lit("pin-"), F.lpad(n.cast("string"), 6, "0")).alias("next_id"))


@query("c11_fingerprint", "SELECT event_id, sha256('file|' || event_type || '|' || regexp_replace(props, '[0-9]+', 'N', 'g')) AS fingerprint FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", F.lit("file"), "event_type", F.regexp_replace("props", "[0-9]+", "N")), 256).alias("fingerprint"))


@query("c19_breaker_statistics", f"WITH {CALLS_SQL} SELECT user_id, count(*) AS calls, count(CASE WHEN failed THEN 1 END) AS failures, count(DISTINCT tool) AS tools, max(seq) AS last_seq FROM calls GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.count_distinct("tool").alias("tools"), F.max("seq").alias("last_seq"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
