"""Operators made of others: outline, focus compression, health audit, repository map, feature data set."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.code import CODE_SQL, defects, extract_exports, extract_imports, sample_code, triage_risk
from quarry.functions.text import contains_error, extension, has_symbol
from quarry.operators.logs import sample_logs
from quarry.plans.graph import circuit_rank
from quarry.plans.spectral import frame_spectrum, verdict
from quarry.plans.stored import cut
from quarry.registry import query
from quarry.sources.snippets import CODE, expected_sql, snippets
from quarry.sources.tables import CALLS_SQL, CHUNKS_SQL, TRADE_SQL, calls, chunks, table, trade

# Patterns of signatures, cosmetic changes and entry files.
SENSITIVE = r"(?i)password|secret|token|api[_-]?key|credential|private[_-]?key"
COSMETIC = r"(?i)^(?:chore|style|docs|fmt|format|lint|typo|bump|merge)\b"
ENTRY_FILES = [r"^index\.", r"^main\.", r"^app\.", r"^server\.", r"\.config\.", r"\.test\.", r"\.spec\.", r"^cli\."]


@query("f3_symbol_nocase", f"WITH {CHUNKS_SQL} SELECT id FROM chunks WHERE lower(symbol_name) = lower('SRC4')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(F.lower("symbol_name") == "src4").select("id")


@query("f8_sensitive_filter", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)password|secret|token|api[_-]?key|credential|private[_-]?key')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(~F.col("text").rlike(SENSITIVE)).select("doc_id")


_SUBJECTS = ["fix: <n>", "Chore(deps): <n>", "style <n>", "chores: <n>", "docs: <n>", "document <n>", "fmt", "FORMAT <n>", "lint! <n>", "typos in <n>", "Bump <n> to 2", "Merge branch '<n>'", "re-merge <n>", "typo: <n>"]
_COSMETIC_ONES = [1, 2, 4, 6, 7, 8, 10, 11, 13]


@query("f10_cosmetic_changes", f"SELECT p_partkey, p_partkey % {len(_SUBJECTS)} IN ({', '.join(map(str, _COSMETIC_ONES))}) AS cosmetic FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of changes of parts: with each of the words, in any case, and with longer words that begin alike."""
    form = F.element_at(F.array(*map(F.lit, _SUBJECTS)), (F.col("p_partkey") % len(_SUBJECTS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(form, F.lit("<n>"), F.col("p_name")).rlike(COSMETIC).alias("cosmetic"))


@query("f11_entry_files", f"WITH {CHUNKS_SQL}, p AS (SELECT id, CASE id % 4 WHEN 0 THEN 'index.ts' WHEN 1 THEN 'src/index.ts' WHEN 2 THEN 'lib/a.test.ts' ELSE 'src/b.ts' END AS path FROM chunks) SELECT id, path FROM p WHERE regexp_matches(path, '^index\\.|^main\\.|^app\\.|^server\\.|\\.config\\.|\\.test\\.|\\.spec\\.|^cli\\.')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 4
    p = chunks(spark, sf_dir).select("id", F.when(k == 0, "index.ts").when(k == 1, "src/index.ts").when(k == 2, "lib/a.test.ts").otherwise("src/b.ts").alias("path"))
    return p.where(F.col("path").rlike("|".join(ENTRY_FILES)))


# What a pinned rule may not hold, its length and how many there are at most.
BLOCKED = {"url": r"(?i)https?://[^\s]+", "sudo": r"(?i)\bsudo\b", "destructive": r"(?i)\brm\s+-rf\b", "download": r"(?i)\b(?:curl|wget)\b", "traversal": r"\.\./", "substitution": r"\$\(", "backtick": r"`[^`]*\$[({][^`]*`", "script": r"(?i)<script\b", "eval": r"(?i)\beval\s*\(", "exec": r"(?i)\bexec\s*\("}
PIN_LENGTH, MOST_PINS = 200, 10


def normal_form(text: Column) -> Column:
    """Compatibility characters replaced by those that they stand for; plain texts do not leave the JVM's hands changed."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return nfkc(text)


def pin_admission(pins: DataFrame) -> DataFrame:
    """``pins`` (with text) with normalized and reason: why a pin is refused, by the first rule that it breaks, or null."""
    trimmed = F.trim("text")
    rules = F.when(trimmed.isNull() | (trimmed == ""), "empty").when(F.length(trimmed) > PIN_LENGTH, "long").when(trimmed.contains("\0"), "nul")
    for name, pattern in BLOCKED.items():
        rules = rules.when(F.col("normalized").rlike(pattern), name)
    return pins.withColumn("normalized", normal_form(trimmed)).withColumn("reason", rules)


_PINS = ["keep <n>", "see HTTP://x.y/<n>", "SUDO <n>", "rm  -rf <n>", "use Wget <n>", "../<n>", "$(<n>)", "`x ${<n>}`", "<Script <n>", "eval (<n>)", "Exec(<n>)", "ｓｕｄｏ <n>", "<n>\0", "  ", "pseudo <n>, evaluate(x)", "ﬁne <n>"]
_REASONS = ["", "url", "sudo", "destructive", "download", "traversal", "substitution", "backtick", "script", "eval", "exec", "sudo", "nul", "empty", "", ""]


@query("f13_pin_admission", f"SELECT c_custkey, CASE c_custkey % {len(_PINS)} {' '.join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_REASONS))} END AS reason, CASE c_custkey % {len(_PINS)} WHEN 0 THEN 'keep ' || c_name WHEN 14 THEN 'pseudo ' || c_name || ', evaluate(x)' WHEN 15 THEN 'fine ' || c_name END AS pinned FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of customers, one form for each rule; what is kept is kept in its normal form."""
    form = F.element_at(F.array(*map(F.lit, _PINS)), (F.col("c_custkey") % len(_PINS) + 1).cast("int"))
    found = pin_admission(table(spark, sf_dir, "customer").select("c_custkey", F.replace(form, F.lit("<n>"), F.col("c_name")).alias("text")))
    return found.select("c_custkey", F.coalesce("reason", F.lit("")).alias("reason"), F.when(F.col("reason").isNull(), F.col("normalized")).alias("pinned"))


#: Rows that a group of chunks keeps.
CHUNK_CAP = 2_000


@query("f14_chunk_cap", f"SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) <= {CHUNK_CAP}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the feature; each task keeps no more rows of a group than the cap before the groups meet."""
    r = F.row_number().over(Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", r.alias("r")).where(F.col("r") <= CHUNK_CAP).drop("r")


def cosine(a: Column, b: Column) -> Column:
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(total(F.transform(wide(v), lambda x: x * x)))
    both = norm(a) * norm(b)
    return F.when(both > 0, total(F.zip_with(wide(a), wide(b), lambda x, y: x * y)) / both).otherwise(0.0)


@query("c13_cosine_rank", "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) + 0.0 AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 11").select(F.col("embedding").alias("q"))  # one vector
    return e.crossJoin(F.broadcast(q)).select("vec_id", (F.round(cosine(F.col("embedding"), F.col("q")), 6) + 0.0).alias("similarity"))


_VERDICT_SQL = """WITH s AS (SELECT s_suppkey AS id, 1 + s_suppkey % 7 / 2.0 AS l0, 1 + s_suppkey % 5 / 2.0 AS l1, 3 + s_suppkey % 4 AS v0, 2 + s_suppkey % 6 AS v1, 40 + s_suppkey % 90 AS n0, 40 + s_suppkey % 70 AS n1 FROM supplier),
  p AS (SELECT *, n1 < n0 AS shrunk, CASE WHEN n1 < n0 THEN l0 / n0 ELSE l0 * v0 / n0 END AS a, CASE WHEN n1 < n0 THEN l1 / n1 ELSE l1 * v1 / n1 END AS b, least(0.30, greatest(0.10, 0.15 * sqrt(50.0 / n1))) AS tolerance FROM s)
  SELECT id, CASE WHEN (a - b) / a > tolerance THEN CASE WHEN shrunk THEN 'APPROVED_DECOUPLING' ELSE 'REJECTED_ENTROPY' END ELSE 'APPROVED' END AS verdict FROM p"""


@query("g9_spectral_verdict", _VERDICT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    args = [1 + k % 7 / 2, 1 + k % 5 / 2, 3 + k % 4, 2 + k % 6, 40 + k % 90, 40 + k % 70]
    return table(spark, sf_dir, "supplier").select(k.alias("id"), verdict(*args).alias("verdict"))


@query("x3_sessions_by_gap", f"WITH {CALLS_SQL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY seq) > INTERVAL '2 hours' THEN 1 ELSE 0 END AS edge FROM calls) SELECT event_id, CAST(sum(edge) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS session FROM g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("seq")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    edge = F.coalesce((us - F.lag(us).over(w) > 7_200_000_000).cast("long"), F.lit(0).cast("long"))
    return calls(spark, sf_dir).withColumn("edge", edge).select("event_id", F.sum("edge").over(w).alias("session"))


@query("x5_error_classes", f"WITH {CALLS_SQL} SELECT event_id, CASE WHEN tool IN ('view', 'click') THEN failed ELSE failed OR event_id % 6 < 4 END AS is_error FROM calls")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that only read are judged by their flag alone, others by their output too."""
    met = calls(spark, sf_dir).join(sample_logs(spark, sf_dir).withColumnRenamed("id", "event_id"), "event_id")
    return met.select("event_id", F.when(F.col("tool").isin("view", "click"), F.col("failed")).otherwise(F.col("failed") | contains_error(F.col("text"))).alias("is_error"))


_GATE = {"outlined": "view", "read_raw": "click", "focused": "purchase"}


@query("x11_gate_flags", f"WITH {CALLS_SQL} SELECT event_id, " + ", ".join(f"coalesce(bool_or(tool = '{t}') OVER w, false) AS {n}" for n, t in _GATE.items()) + " FROM calls WINDOW w AS (PARTITION BY user_id, event_id % 3 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session did with a file before each call: outlined it, read it raw, looked at a symbol."""
    w = Window.partitionBy("user_id", F.col("event_id") % 3).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return calls(spark, sf_dir).select("event_id", *[F.coalesce(F.bool_or(F.col("tool") == t).over(w), F.lit(False)).alias(n) for n, t in _GATE.items()])


def repo_map(files: DataFrame) -> DataFrame:
    """imports, exports, n_lines of (path, code), besides the other columns."""
    ext = extension(F.col("path"))
    return files.select(*[c for c in files.columns if c != "code"], extract_imports(F.col("code"), ext).alias("imports"), extract_exports(F.col("code"), ext).alias("exports"), F.size(F.split("code", "\n", -1)).cast("long").alias("n_lines"))


@query("r15_repository_map", f"WITH {CODE_SQL} SELECT path, count(*) AS files, count(DISTINCT regexp_extract(code, '(?:function|def|func) ([A-Za-z0-9]+)', 1)) AS exports, CAST(sum(len(string_split(code, chr(10)))) AS BIGINT) AS n_lines FROM code GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = repo_map(sample_code(spark, sf_dir))
    return m.groupBy("path").agg(F.count("*").alias("files"), F.count_distinct("exports").alias("exports"), F.sum("n_lines").alias("n_lines"))


def map_views(repo: DataFrame) -> DataFrame:
    """path, skeleton (what a file exports), full (also what it imports, and its lines)."""
    skeleton = F.concat("path", F.lit(": "), F.array_join("exports", ", "))
    return repo.select("*", skeleton.alias("skeleton"), F.concat(skeleton, F.lit(" <- "), F.array_join("imports", ", "), F.lit(" ("), F.col("n_lines").cast("string"), F.lit(")")).alias("full"))


@query("r15_map_views", f"""SELECT id, path || ': ' || replace(exports, ',', ', ') AS skeleton, path || ': ' || replace(exports, ',', ', ') || ' <- ' || replace(imports, ',', ', ') || ' (' || len(string_split(code, chr(10))) || ')' AS "full"
  FROM ({expected_sql(CODE, 'path', 'code', 'exports', 'imports')})""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_views(repo_map(snippets(spark, sf_dir, CODE))).select("id", "skeleton", "full")


def outline(symbols: DataFrame, budget: int = 6000) -> DataFrame:
    """id, risk, defects, folded: rows of low risk without any defect fold into a list of names."""
    name, lines = F.regexp_extract("code", r"(?:function|def|func) (\w+)", 1), F.size(F.split("code", "\n", -1))
    rows = symbols.select("id", "path", name.alias("name"), triage_risk(name, F.col("code"), lines).alias("risk"), defects(F.col("code")).alias("defects"))
    return rows.withColumn("folded", (F.col("risk") == "LOW") & (F.size("defects") == 0))


@query("r10_outline", f"SELECT *, risk = 'LOW' AND defects = '' AS folded FROM ({expected_sql(CODE, 'path', 'name', 'risk', 'defects')})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(snippets(spark, sf_dir, CODE)).select("id", "path", "name", "risk", F.array_join("defects", ",").alias("defects"), "folded")


def focus(rows: DataFrame, symbol: str, downstream: int = 10, limit: float = 0.85) -> DataFrame:
    """Zones of the chunks of a file around a symbol, and the compressed text of each file.

    The focus stays whole; chunks that it names keep their first line, chunks that name it
    keep their name; the rest is only counted.  A result of 0.85 of the size or more is rejected.
    """
    own = rows.where(F.col("name") == symbol).groupBy("file").agg(F.first("code").alias("center"))
    met = rows.join(own, "file")
    zone = F.when(F.col("name") == symbol, "focus").when(has_symbol(F.col("code"), symbol), "upstream").when(F.expr("instr(center, name) > 0"), "downstream").otherwise("rest")
    met = met.withColumn("zone", zone).withColumn("rank", F.row_number().over(Window.partitionBy("file", "zone").orderBy("id")))
    text = F.when(F.col("zone") == "focus", F.col("code")).when((F.col("zone") == "downstream") & (F.col("rank") <= downstream), F.element_at(F.split("code", "\n"), 1)).when((F.col("zone") == "upstream") & (F.col("rank") <= downstream), F.col("name"))
    order = F.when(F.col("zone") == "focus", 0).when(F.col("zone") == "downstream", 1).otherwise(2)
    out = met.groupBy("file").agg(F.sum(F.length("code")).alias("before"), F.count_if(F.col("zone") == "rest").alias("rest"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "id", text.alias("t")))).alias("l"))
    out = out.withColumn("text", F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    return out.withColumn("accepted", F.length("text") < F.col("before") * limit).select("file", "before", "rest", "text", "accepted")


_FOCUS_SQL = r"""WITH d AS (SELECT source AS file, doc_id AS id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN 'center' ELSE 's' || doc_id END AS name, text AS code FROM documents),
  m AS (SELECT d.*, c.code AS center FROM d JOIN d c ON c.file = d.file AND c.name = 'center'),
  z AS (SELECT *, CASE WHEN name = 'center' THEN 'focus' WHEN regexp_matches(code, '(^|[^a-zA-Z0-9_$])center($|[^a-zA-Z0-9_$])') THEN 'upstream' WHEN contains(center, name) THEN 'downstream' ELSE 'rest' END AS zone FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY file, zone ORDER BY id) AS rank FROM z),
  t AS (SELECT *, CASE WHEN zone = 'focus' THEN code WHEN zone = 'downstream' AND rank <= 10 THEN split_part(code, chr(10), 1) WHEN zone = 'upstream' AND rank <= 10 THEN name END AS t, CASE zone WHEN 'focus' THEN 0 WHEN 'downstream' THEN 1 ELSE 2 END AS o FROM r),
  g AS (SELECT file, CAST(sum(length(code)) AS BIGINT) AS before, count(*) FILTER (WHERE zone = 'rest') AS rest, coalesce(string_agg(t, chr(10) ORDER BY o, id), '') AS text FROM t GROUP BY 1)
  SELECT *, length(text) < before * 0.85 AS accepted FROM g"""


@query("r11_focus_compression", _FOCUS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("code"))
    d = d.withColumn("name", F.when(F.row_number().over(Window.partitionBy("file").orderBy("id")) == 1, "center").otherwise(F.col("name")))
    return focus(d, "center")


@query("c22_trade_spectrum_ego")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.graph import ego

    e = cut(ego(trade(spark, sf_dir), 3))
    v = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    s, _ = frame_spectrum(v, e.withColumn("weight", F.lit(1.0)))
    return circuit_rank(v, e).withColumn("lambda2", F.lit(round(s.lambda2 or 0.0, 6)))


@query("g1_graph_summary", f"WITH {TRADE_SQL} SELECT n_nationkey AS node, (SELECT count(*) FROM trade WHERE dst = n_nationkey) AS in_degree, (SELECT count(*) FROM trade WHERE src = n_nationkey) AS out_degree FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    t = cut(trade(spark, sf_dir))
    count = lambda c, n: t.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(n))
    met = v.join(count("dst", "in_degree"), "node", "left").join(count("src", "out_degree"), "node", "left")
    return met.select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
