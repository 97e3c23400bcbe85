"""Log condensing: runs, repeated blocks, near-equal lines, library frames, error summaries."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ship import ship
from quarry.functions.text import contains_error, error_fingerprint, normalize_line, strip_ansi
from quarry.registry import query
from quarry.sources.snippets import OUTPUTS, expected_sql, snippets
from quarry.sources.tables import spread, table

# What library frames and errors look like.
FRAME = r"node_modules[/\\]|\(internal/|node:internal/"
CODED = r"error TS(\d+):\s*(.+)"
NAMED = r"^(\w*Error):\s*(.+)"
PACKAGE = r"(?i)^npm (?:ERR!|error)\s*(.+)"
_FILES = r"[\w/.-]+\.(?:ts|tsx|js|jsx|py|go|mjs|cjs|mts|cts)"


def collapse(lines: list[str], longest: int = 20) -> list[str]:
    """Runs of more than two equal lines, and blocks of 3 to 20 lines that repeat, are shown once."""
    out: list[str] = []
    i, n = 0, len(lines)
    while i < n:
        run = 1
        while i + run < n and lines[i + run] == lines[i]:
            run += 1
        if run > 2:
            out += [lines[i], f"  [repeated {run - 1} more times]"]
            i += run
            continue
        size = next((k for k in range(3, min(longest, (n - i) // 2) + 1) if lines[i : i + k] == lines[i + k : i + 2 * k]), 0)
        if size:
            times = 2
            while lines[i + times * size : i + (times + 1) * size] == lines[i : i + size]:
                times += 1
            out += [*lines[i : i + size], f"  [block repeated {times} times, showing once]"]
            i += times * size
        else:
            out += [lines[i]] * run
            i += run
    return out


# The same keys as of ``normalize_line``, for lines that are in Python already.
_ALWAYS = [(re.compile("0x[a-f0-9]+", re.I), "0xADDR"), (re.compile("[0-9]{13,}"), "TIMESTAMP")]
_LIBRARY = [(re.compile(":[0-9]+:[0-9]+"), ":L:C"), *_ALWAYS, (re.compile(r":[0-9]+\)"), ":N)")]
_FRAME = re.compile(FRAME)


def line_key(line: str) -> str:
    for pattern, to in _LIBRARY if "node_modules" in line or "internal/" in line or "<anonymous>" in line else _ALWAYS:
        line = pattern.sub(to, line)
    return line.strip(" ")


def first_of_key(lines: list[str]) -> list[str]:
    """Lines whose normalized form has not occurred before."""
    first: dict[str, str] = {}
    for x in lines:
        first.setdefault(line_key(x), x)
    return list(first.values())


def marked(lines: list[str]) -> list[str]:
    """Consecutive library frames become one line with their number."""
    out: list[str] = []
    for frame, group in groupby(lines, key=lambda x: bool(_FRAME.search(x))):
        own = list(group)
        out += [f"  [{len(own)} frames in node_modules/internal]"] if frame else own
    return out


def mark_frames(lines: Column) -> Column:
    """Consecutive library frames become one line with their number, by an ordered fold."""
    mark = lambda n: F.concat(F.lit("  ["), n.cast("string"), F.lit(" frames in node_modules/internal]"))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def step(a, l):
        flushed = F.when(a["n"] > 0, F.concat(a["out"], F.array(mark(a["n"])))).otherwise(a["out"])
        return F.when(l.rlike(FRAME), F.struct(a["out"].alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(flushed, F.array(l)).alias("out"), F.lit(0).alias("n")))

    return F.aggregate(lines, zero, step, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(mark(a["n"])))).otherwise(a["out"]))


def condense(logs: DataFrame, id_col: str, text_col: str, max_lines: int = 100) -> DataFrame:
    """id, lines, n_lines, reduction (percent of characters) of each log text."""
    ship(logs.sparkSession)

    @F.pandas_udf("array<string>")
    def short(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[str]:
            lines = marked(first_of_key(collapse(text.split("\n"))))
            more = len(lines) - max_lines
            return [*lines[:max_lines], f"... [{more} lines truncated]"] if more > 0 else lines

        return texts.map(one)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = logs.select(F.col(id_col).alias("id"), F.length(text).alias("before"), short(strip_ansi(text)).alias("lines"))
    after = F.length(F.array_join("lines", "\n"))
    return rows.select("id", "lines", F.size("lines").cast("long").alias("n_lines"), F.greatest(F.lit(0), F.floor((1 - after / F.greatest("before", F.lit(1))) * 100 + 0.5)).cast("long").alias("reduction"))


def error_summary(logs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sorted distinct errors, the first one, and the files that are named."""
    lines = logs.select(F.col(id_col).alias("id"), F.posexplode(F.split(strip_ansi(F.col(text_col)), "\n", -1)).alias("p", "line"))
    fail = r"(?:FAIL|✕|×|✗)\s+(" + _FILES + ")"
    part = lambda p, k: F.trim(F.regexp_extract("line", p, k))
    found = F.array(
        F.when(F.col("line").rlike(CODED), F.concat(F.lit("TS"), part(CODED, 1), F.lit(": "), part(CODED, 2))),
        F.when(F.col("line").rlike(NAMED), F.concat(part(NAMED, 1), F.lit(": "), part(NAMED, 2))),
        F.when(F.col("line").rlike(PACKAGE), F.concat(F.lit("npm: "), part(PACKAGE, 1))),
        F.when(F.col("line").rlike(fail), F.concat(F.lit("FAIL: "), part(fail, 1))),
    )
    files = F.regexp_extract_all("line", F.lit(r"(?:^|\s)(" + _FILES + r")\b"), F.lit(1))
    rows = lines.select("id", "p", F.array_compact(found).alias("e"), files.alias("f"))
    return rows.groupBy("id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("e")))).alias("errors"),
        F.min_by(F.get("e", 0), F.when(F.size("e") > 0, F.col("p"))).alias("first_error"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("f")))).alias("files"),
    )


_LOG_SQL = """logs AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'TypeError: bad ' || user_id || chr(10) || 'at src/a' || user_id || '.ts:1:2' WHEN 1 THEN 'error TS' || (2300 + user_id) || ': no x' || chr(10) || 'SyntaxError: y' WHEN 2 THEN 'npm ERR! code ' || user_id WHEN 3 THEN 'FAIL lib/t' || user_id || '.js' ELSE 'ok line ' || user_id || ':3:4 0xAB' || user_id END AS text FROM events)"""


def sample_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, nl = F.col("user_id").cast("string"), F.lit("\n")
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("TypeError: bad "), u, nl, F.lit("at src/a"), u, F.lit(".ts:1:2")))
        .when(kind == 1, F.concat(F.lit("error TS"), (2300 + F.col("user_id")).cast("string"), F.lit(": no x"), nl, F.lit("SyntaxError: y")))
        .when(kind == 2, F.concat(F.lit("npm ERR! code "), u))
        .when(kind == 3, F.concat(F.lit("FAIL lib/t"), u, F.lit(".js")))
        .otherwise(F.concat(F.lit("ok line "), u, F.lit(":3:4 0xAB"), u))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text"))


@query("t15_error_fingerprint", f"WITH {_LOG_SQL} SELECT id, substr(sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ':[0-9]+:[0-9]+', ':[L]:[C]', 'g'), 'line [0-9]+', 'line N', 'gi'), '[0-9]{{13,}}', '[TS]', 'g'), '0x[a-f0-9]+', '[MEM]', 'gi'), ' ')), 1, 16) AS fingerprint FROM logs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_logs(spark, sf_dir).select("id", error_fingerprint(F.col("text")).alias("fingerprint"))


@query("t16_contains_error", expected_sql(OUTPUTS, "is_error"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir, OUTPUTS).select("id", contains_error(F.col("code")).cast("string").alias("is_error"))


@query("t13_line_normalizer", f"WITH {_LOG_SQL} SELECT id, trim(regexp_replace(regexp_replace(text, '0x[a-f0-9]+', '0xADDR', 'gi'), '[0-9]{{13,}}', 'TIMESTAMP', 'g'), ' ') AS norm FROM logs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_logs(spark, sf_dir).select("id", normalize_line(F.col("text")).alias("norm"))


@query("t14_error_summary", f"""WITH {_LOG_SQL}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM logs),
  e AS (SELECT id, p, CASE WHEN regexp_matches(line, 'error TS[0-9]+:') THEN 'TS' || regexp_extract(line, 'error TS([0-9]+)', 1) || ': ' || regexp_extract(line, 'error TS[0-9]+: *(.+)', 1) WHEN regexp_matches(line, '^[A-Za-z]*Error:') THEN line WHEN line LIKE 'npm ERR!%' THEN 'npm: ' || substr(line, 10) WHEN line LIKE 'FAIL %' THEN 'FAIL: ' || substr(line, 6) END AS err FROM l)
  SELECT id, coalesce(array_to_string(list_sort(list(DISTINCT err) FILTER (WHERE err IS NOT NULL)), '|'), '') AS errors, min_by(err, p) FILTER (WHERE err IS NOT NULL) AS first_error FROM e GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_summary(sample_logs(spark, sf_dir), "id", "text").select("id", F.array_join("errors", "|").alias("errors"), "first_error")


@query("r14_log_filter")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return condense(docs, "doc_id", "text", 50).select(F.col("id").alias("doc_id"), "n_lines", "reduction", F.array_join("lines", "\n").alias("text"))


@query("w12_frame_markers", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'th'))) AS frames FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Frames here are lines with "th"; the number of frames is kept by the markers.
    lines = F.split(F.regexp_replace("text", "th", "node_modules/"), "\n", -1)
    marked = F.filter(mark_frames(lines), lambda l: l.rlike(r"^  \[\d+ frames in"))
    total = F.aggregate(F.transform(marked, lambda l: F.regexp_extract(l, r"(\d+)", 1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "documents").select("doc_id", total.alias("frames"))


@query("t12_plain_texts", "SELECT doc_id, text || 'x' || text AS text FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without colours, titles, character sets and modes of a terminal."""
    noisy = F.concat(F.lit("\x1b[1;31m"), "text", F.lit("\x1b[0m\x1b]0;title\x07x\x1b(B"), "text", F.lit("\x1b=\x1b[2K"))
    return table(spark, sf_dir, "documents").select("doc_id", strip_ansi(noisy).alias("text"))


@query("w10_block_collapse", """WITH k AS (SELECT o_orderkey AS id, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), b AS (SELECT *, chr(10) || 'a' || id || chr(10) || 'b' || chr(10) || 'c' AS block FROM k)
  SELECT id, 'begin' || CASE WHEN k = 0 THEN '' WHEN k = 1 THEN block ELSE block || chr(10) || '  [block repeated ' || k || ' times, showing once]' END || chr(10) || 'end' || CASE WHEN k > 2 THEN chr(10) || '  [repeated ' || (k - 1) || ' more times]' ELSE repeat(chr(10) || 'end', greatest(k - 1, 0)) END AS text FROM b""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of three lines for each line of an order, and a last line as often."""
    ship(spark)
    counts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("k")), "id", "left")
    k = F.coalesce("k", F.lit(0)).cast("int")
    block = F.array(F.concat(F.lit("a"), F.col("id").cast("string")), F.lit("b"), F.lit("c"))
    lines = F.concat(F.array(F.lit("begin")), F.flatten(F.array_repeat(block, k)), F.array_repeat(F.lit("end"), F.greatest(k, F.lit(1))))

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\n".join(collapse(t.split("\n"))))

    return counts.select("id", shown(F.array_join(lines, "\n")).alias("text"))
