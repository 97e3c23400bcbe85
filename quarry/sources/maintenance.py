"""Scans in a fixed order, history as tables, commits of several tables, manifests, serialized state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.ship import ship
from quarry.functions.text import extension
from quarry.plans.stored import cut, new_path
from quarry.registry import query
from quarry.sources.files import read_json_lines, scan_folder, tail_json_lines
from quarry.sources.tables import CALLS_SQL, TRADE_SQL, calls, table, trade

# Folders that scans leave out, suffixes of declarations, keys that loads strip.
IGNORED_FOLDERS = ["node_modules", ".git", "dist", "build", "coverage", ".next"]
DECLARATIONS = ".d.ts"
UNSAFE_KEYS = ["__proto__", "constructor", "prototype"]
#: What a manifest of another version knows is not used.
MANIFEST_VERSION = 3


def walk(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Admitted files below a folder without declarations and ignored folders, sorted by path."""
    files = scan_folder(spark, folder, extensions, IGNORED_FOLDERS)
    return files.where(~F.col("path").endswith(DECLARATIONS)).orderBy("path")


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, text) as one file each below ``root``, on the executors; how many."""
    ship(files.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "text").mapInArrow(task, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


_TREE_SQL = "CASE s_suppkey % 6 WHEN 0 THEN 'src/a' || s_suppkey || '.ts' WHEN 1 THEN 'node_modules/m' || s_suppkey || '.ts' WHEN 2 THEN 'src/deep/er/t' || s_suppkey || '.d.ts' WHEN 3 THEN 'lib/b' || s_suppkey || '.py' WHEN 4 THEN 'lib/c' || s_suppkey || '.min.js' ELSE 'lib/d' || s_suppkey || '.txt' END"


@query("s2_deterministic_scan", f"WITH f AS (SELECT {_TREE_SQL} AS path, s_name AS text, s_suppkey % 6 AS k FROM supplier) SELECT path, row_number() OVER (ORDER BY path) AS place, text FROM f WHERE k IN (0, 3)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("s_suppkey") % 6, F.col("s_suppkey").cast("string")
    name = lambda a, b: F.concat(F.lit(a), s, F.lit(b))
    path = F.when(k == 0, name("src/a", ".ts")).when(k == 1, name("node_modules/m", ".ts")).when(k == 2, name("src/deep/er/t", ".d.ts")).when(k == 3, name("lib/b", ".py")).when(k == 4, name("lib/c", ".min.js")).otherwise(name("lib/d", ".txt"))
    root = new_path(spark, "tree")
    # Files begin with a byte order mark, which a scan removes.
    write_files(table(spark, sf_dir, "supplier").select(path.alias("path"), F.concat(F.lit("﻿"), "s_name").alias("text")), root)
    found = walk(spark, root, [".ts", ".js", ".py"])
    inside = F.regexp_extract("path", r"/((?:src|lib|node_modules)/[^?]*)$", 1)
    return found.select(inside.alias("path"), F.row_number().over(Window.orderBy("path")).cast("long").alias("place"), "text")  # paths of one small tree


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the candidates that is there."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


@query("s6_json_tail", "SELECT event_id, event_type AS tool_name FROM events WHERE event_id % 2 = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run over a folder sees: only the lines that came since the first."""
    path, out = new_path(spark, "json-tail"), new_path(spark, "json-tail-out")
    schema = "event_id long, tool_name string"
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool_name"))
    for half in (0, 1):
        line = F.to_json(F.struct("event_id", "tool_name"))
        rows.where(F.col("event_id") % 2 == half).select(line.alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string")).write.mode("append").text(path)

        def put(batch: DataFrame, _: int, half: int = half) -> None:
            batch.where("event_id is not null").write.mode("overwrite").parquet(f"{out}/run={half}")

        tail_json_lines(spark, path, schema).writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/run=1")


# History of a repository, from the lines of its log and of its raw differences.


def parse_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """hash, epoch, subject of lines hash|epoch|subject; subjects may hold bars, other lines go."""
    part = lambda k: F.regexp_extract(column, r"^([0-9a-f]{7,64})\|(\d+)\|(.*)$", k)
    return lines.where(F.col(column).rlike(r"^[0-9a-f]{7,64}\|\d+\|")).select(part(1).alias("hash"), part(2).cast("long").alias("epoch"), part(3).alias("subject"))


def parse_raw_diff(lines: DataFrame, column: str = "line") -> DataFrame:
    """status, old_blob, new_blob, path of raw difference lines; a rename gives its new path."""
    pattern = r"^:\d+ \d+ ([0-9a-f]+) ([0-9a-f]+) ([A-Z])\d*\t(?:[^\t]*\t)?([^\t]*)$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    return lines.where(F.col(column).rlike(pattern)).select(part(3).alias("status"), part(1).alias("old_blob"), part(2).alias("new_blob"), part(4).alias("path"))


@query("s10_log_lines", "SELECT md5(CAST(o_orderkey AS VARCHAR)) AS hash, o_orderkey * 10 AS epoch, o_orderpriority || '|' || o_orderstatus AS subject FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.md5(F.col("o_orderkey").cast("string").cast("binary")), (F.col("o_orderkey") * 10).cast("string"), "o_orderpriority", "o_orderstatus")
    return parse_log(table(spark, sf_dir, "orders").select(line.alias("line")).unionByName(spark.createDataFrame([("not a commit",)], "line string")))


@query("s10_raw_differences", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'A' ELSE 'R' END AS status, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS new_blob, 'src/f' || o_orderkey || '.ts' AS path FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    status = F.when(k == 0, "M\t").when(k == 1, "A\t").otherwise(F.concat(F.lit("R087\told/f"), key, F.lit("\t")))
    line = F.concat(F.lit(":100644 100644 0000000 "), F.substring(F.md5(key.cast("binary")), 1, 12), F.lit(" "), status, F.lit("src/f"), key, F.lit(".ts"))
    return parse_raw_diff(table(spark, sf_dir, "orders").select(line.alias("line"))).drop("old_blob")


def load_state(json_column: Column) -> Column:
    """A JSON object as a map of strings, without keys that could change a prototype; null if it is malformed."""
    return F.map_filter(F.from_json(json_column, "map<string,string>"), lambda k, _: ~k.isin(UNSAFE_KEYS))


@query("s14_safe_state", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(1 AS BIGINT) AS n FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    unsafe = F.concat(F.lit('{"__proto__": {"a": 1}, "constructor": 2, '), F.substring("props", 2, 1_000_000))
    state = load_state(unsafe)
    return table(spark, sf_dir, "events").select("event_id", state["k"].alias("k"), F.size(state).cast("long").alias("n"))


# Sinks.


def commit_tables(spark: SparkSession, root: str, version: int, tables: dict[str, DataFrame]) -> None:
    """Write all tables of a version, then its mark.  Without the mark no reader sees any of them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version:08d}/{name}")
    spark.createDataFrame([(version, sorted(tables))], "version long, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{root}/v{version:08d}/_commit")


def last_version(spark: SparkSession, root: str) -> int:
    """The last version that was committed; 0 without any.  What a crash left behind doesn't count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    done = [n for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_commit/_SUCCESS"))]
    return max((int(n[1:]) for n in done), default=0)


def read_committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the last committed version; empty without one."""
    version = last_version(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v{version:08d}/{name}") if version else spark.createDataFrame([], schema)


@query("k12_commit_of_tables", "SELECT s_suppkey, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables committed together; a later attempt that never finished is not seen."""
    root = new_path(spark, "commit")
    s, n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    commit_tables(spark, root, 1, {"supplier": s, "nation": n})
    s.withColumn("s_acctbal", F.lit(0.0)).write.parquet(f"{root}/v{2:08d}/supplier")
    got = read_committed(spark, root, "supplier", "s_suppkey long, s_nationkey int, s_acctbal double")
    nations = read_committed(spark, root, "nation", "n_nationkey int, n_name string")
    return got.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", "n_name")


def debounced(rows: DataFrame, key: str, at: str, quiet: float) -> DataFrame:
    """Trailing rows: those after which the key is quiet for longer than ``quiet`` seconds.  As a stream: a trigger of that interval."""
    later = F.lead(at).over(Window.partitionBy(key).orderBy(at, *[c for c in rows.columns if c not in (key, at)][:1]))
    return rows.withColumn("_later", later).where(F.col("_later").isNull() | (F.col("_later") - F.col(at) > quiet)).drop("_later")


@query("k8_debounced_saves", f"WITH {CALLS_SQL}, l AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM calls) SELECT event_id FROM l WHERE n IS NULL OR n - t > 7200")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return debounced(rows, "user_id", "t", 7200.0).select("event_id")


def graph_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """node, json: neighbours and degrees of each vertex, empty sets and zero degrees left out."""
    side = lambda a, b, n: edges.groupBy(F.col(a).alias("node")).agg(F.sort_array(F.collect_set(b)).alias(n))
    met = vertices.join(side("src", "dst", "imports"), "node", "left").join(side("dst", "src", "importers"), "node", "left")
    return met.select("node", F.to_json(F.struct("imports", "importers", F.nullif(F.coalesce(F.size("importers"), F.lit(0)), F.lit(0)).alias("in_degree"))).alias("json"))


@query("k14_graph_json", f"""WITH {TRADE_SQL}, o AS (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS l FROM (SELECT DISTINCT src, dst FROM trade) GROUP BY 1), i AS (SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS l, count(*) AS n FROM (SELECT DISTINCT src, dst FROM trade) GROUP BY 1)
  SELECT n_nationkey AS node, '{{' || concat_ws(',', '"imports":[' || o.l || ']', '"importers":[' || i.l || ']', '"in_degree":' || i.n) || '}}' AS json FROM nation LEFT JOIN o ON src = n_nationkey LEFT JOIN i ON dst = n_nationkey""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_json(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), cut(trade(spark, sf_dir).select("src", "dst")))


def manifest_status(files: DataFrame, manifest: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """key (of the path), status of each file against a manifest (key, digest, version): fresh, stale, outdated or missing.

    ``also``: columns of both that tell files of one path apart.  Of several entries of a file the one of the latest version counts.
    """
    now = files.select(F.substring(F.sha2("path", 256), 1, 16).alias("key"), *also, "digest")
    known = manifest.groupBy("key", *also).agg(F.max(F.struct("version", "digest")).alias("m")).select("key", *also, F.col("m.digest").alias("was"), "m.version")
    met = now.join(known, ["key", *also], "left")
    return met.select("key", F.when(F.col("version").isNull(), "missing").when(F.col("version") != MANIFEST_VERSION, "outdated").when(F.col("was") != F.col("digest"), "stale").otherwise("fresh").alias("status"))


@query("k15_cache_manifest", "SELECT substr(sha256(url), 1, 16) AS key, CASE page_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'outdated' WHEN 2 THEN 'stale' ELSE 'fresh' END AS status FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id", F.md5(F.col("html").cast("binary")).alias("digest"), (F.col("page_id") % 5).alias("k"))
    known = files.where("k <> 0").select(F.substring(F.sha2("path", 256), 1, 16).alias("key"), "page_id", F.when(F.col("k") == 2, "other").otherwise(F.col("digest")).alias("digest"), F.when(F.col("k") == 1, 2).otherwise(MANIFEST_VERSION).alias("version"))
    return manifest_status(files, known, ("page_id",))


_MESSAGES = "array<struct<ruleId:string,severity:int,line:int,column:int,message:string>>"


def diagnostic_rows(reports: DataFrame) -> DataFrame:
    """file, line, column, code, severity, message of reports (file, messages): a JSON array with positions from zero, which become positions from one.

    Reports that are no such array, and messages without a position, have no rows; messages without a rule have the code unknown.
    """
    m = reports.select("file", F.explode(F.from_json("messages", _MESSAGES)).alias("m")).where(F.col("m.line").isNotNull())
    severity = F.when(F.col("m.severity") >= 2, "error").otherwise("warning")
    return m.select("file", (F.col("m.line") + 1).alias("line"), (F.coalesce("m.column", F.lit(0)) + 1).alias("column"), F.coalesce("m.ruleId", F.lit("unknown")).alias("code"), severity.alias("severity"), F.trim("m.message").alias("message"))


@query("c12_diagnostic_rows", """SELECT 'f' || l_orderkey || '.ts' AS file, CAST(l_partkey + 1 AS INTEGER) AS line, CAST(l_suppkey + 1 AS INTEGER) AS column, CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'rule-' || l_returnflag END AS code,
  CASE WHEN l_linenumber >= 2 THEN 'error' ELSE 'warning' END AS severity, 'said "' || l_linestatus || '"' AS message FROM lineitem""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a file, its lines are what a checker reported of it."""
    rule = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("rule-"), "l_returnflag"))
    one = F.struct(rule.alias("ruleId"), F.col("l_linenumber").alias("severity"), F.col("l_partkey").alias("line"), F.col("l_suppkey").alias("column"), F.concat(F.lit(' said "'), "l_linestatus", F.lit('" ')).alias("message"))
    reports = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(one)).alias("messages"))
    broken = reports.select(F.lit("broken.ts").alias("file"), F.concat(F.lit("no "), "messages").alias("messages"))
    return diagnostic_rows(reports.select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("file"), "messages").unionByName(broken))


def usage_report(calls: DataFrame) -> DataFrame:
    """user, text: a line for each tool with its calls and tokens, most tokens first, after a line with the totals.

    ``calls``: user, tool, tokens, id.  Tokens are added in the order of ``id``, since the floor of a sum of doubles
    depends on the order, and what tasks and shuffles give is none.
    """
    order = Window.partitionBy("user", "tool").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = calls.select("user", "tool", F.row_number().over(order).alias("n"), F.sum("tokens").over(order).alias("t"))
    per_tool = added.groupBy("user", "tool").agg(F.max("n").cast("long").alias("n"), F.floor(F.max_by("t", "n")).alias("t"))
    # A tool without a name, or without any tokens, counts in the totals and has no line; a user without lines has no text.
    line = F.when(F.col("tool").isNotNull() & F.col("t").isNotNull(), F.format_string("%s: %d calls, %d tokens", "tool", "n", "t"))
    per_user = per_tool.groupBy("user").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("o"), "tool", line.alias("line")))).alias("l"))
    lines = F.array_compact(F.transform("l", lambda x: x["line"]))
    return per_user.select("user", F.when(F.size(lines) > 0, F.concat_ws("\n", F.format_string("total: %d calls, %d tokens", "n", "t"), lines)).alias("text"))


@query("c25_usage_report", """WITH t AS (SELECT user_id AS "user", event_type AS tool, count(*) AS n, CAST(floor(sum(value)) AS BIGINT) AS t FROM events GROUP BY 1, 2)
  SELECT "user", 'total: ' || sum(n) || ' calls, ' || sum(t) || ' tokens' || chr(10) || string_agg(tool || ': ' || n || ' calls, ' || t || ' tokens', chr(10) ORDER BY t DESC, tool) AS text FROM t GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are added as the rows stand in the table's files, which is the order of the SQL, and not that of the event's ids."""
    place = F.struct("_metadata.file_name", "_metadata.row_index")
    return usage_report(table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("tool"), F.col("value").alias("tokens"), place.alias("id")))


@query("c23_expected_changes", "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = l_linestatus)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that are no own writes: an order expects its own status, any other of a line is a change from outside."""
    changes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    return changes.join(expected, ["l_orderkey", "l_linestatus"], "left_anti")


@query("x13_resume_and_poison", "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 3 <> 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run: what the first one has done is left out, and so are records that cannot be read."""
    path = new_path(spark, "resume")
    rows = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id")))
    rows.select(line.alias("value")).write.text(path)
    done = rows.where("event_id % 3 = 0").select("event_id")
    return read_json_lines(spark, path, "event_id long").where("event_id is not null").join(done, "event_id", "left_anti")


@query("s3_test_files", "SELECT page_id, page_id % 4 IN (0, 1) AS is_test FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("src/a"), p, F.lit(".test.ts"))).when(k == 1, F.concat(F.lit("/tests/b"), p, F.lit(".py"))).when(k == 2, F.concat(F.lit("src/latest"), p, F.lit(".ts"))).otherwise(F.concat(F.lit("src/testing-guide"), p, F.lit(".md")))
    return table(spark, sf_dir, "pages").select("page_id", is_test_file(path).alias("is_test"))


def is_test_file(path: Column) -> Column:
    """Named .test. or .spec., or below a folder of tests; sources only."""
    named = path.rlike(r"\.(?:test|spec)\.[^./]+$") | path.rlike(r"(?:^|/)(?:tests?|__tests__)/")
    return named & extension(path).isin(".ts", ".tsx", ".js", ".jsx", ".py", ".go")
