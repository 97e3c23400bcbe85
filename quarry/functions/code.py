"""Functions on source text: comments, signatures, imports, exports, risk, stemming, token pruning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ship import ship
from quarry.functions.text import extension, identifiers, split_identifier, token_estimate
from quarry.registry import query
from quarry.sources.snippets import CODE, expected_sql, snippets
from quarry.sources.tables import table

# --- Porter stemmer, from the published algorithm --------------------------------------
# Suffix rules of steps 2 to 4, tried in this order.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """The word as a string of c and v; y is a vowel after a consonant."""
    out = []
    for k, c in enumerate(word):
        vowel = c in "aeiou" or c == "y" and k > 0 and out[-1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, to in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > least and (suffix != "ion" or stem[-1:] in ("s", "t")):
                return stem + to
            return word
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lower()
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, STEP2, 0)
    w = _swap(w, STEP3, 0)
    w = _swap(w, [(s, "") for s in STEP4], 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """term, stem of the distinct terms: Python sees each word once."""
    ship(terms.sparkSession)

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return terms.select(column).distinct().select(column, run(column).alias("stem"))


@query("t3_porter_stems")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return stem_terms(words)


@query("t1_identifier_parts", "SELECT DISTINCT p_brand, array_to_string(list_distinct(list_transform(regexp_extract_all(regexp_replace('get' || upper(p_brand) || 'ApiOf', '([A-Z]{2,})([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))).list_sort(), ' ') AS parts FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("get"), F.upper("p_brand"), F.lit("ApiOf"))
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.array_join(F.sort_array(split_identifier(name)), " ").alias("parts"))


@query("t4_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS code, CAST(ceil(length(text) / 4.0) AS BIGINT) AS prose FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("code"), token_estimate(F.col("text"), True).alias("prose"))


@query("t5_identifiers", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[a-zA-Z_$][a-zA-Z0-9_$]*'))) AS n FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(identifiers(F.col("text"))).cast("long").alias("n"))


def strip_comments(code: Column) -> Column:
    """Without block and line comments, console and print lines, debugger statements, trailing white space and runs of blank lines."""
    for pattern, to in [(r"(?s)/\*.*?\*/", ""), (r"(?m)(?<!:)//[^\n]*$", ""), (r"(?m)^\s*console\.\w+\([^()\n]*\);?[ \t]*$", ""), (r"(?m)^\s*debugger;?[ \t]*$", ""), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n")]:
        code = F.regexp_replace(code, pattern, to)
    return F.regexp_replace(code, r"^\s+|\s+$", "")


def extract_imports(code: Column, ext: Column) -> Column:
    """Imported module names of TypeScript, JavaScript, Python and Go sources, sorted, each once."""
    all_ = lambda p: F.regexp_extract_all(code, F.lit(p), F.lit(1))
    script = F.concat(all_(r"from\s+['\"]([^'\"]+)['\"]"), all_(r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"), all_(r"import\(\s*['\"]([^'\"]+)['\"]\s*\)"), all_(r"(?m)^\s*import\s+['\"]([^'\"]+)['\"]"))
    python = F.concat(all_(r"(?m)^\s*from\s+([\w.]+)\s+import"), all_(r"(?m)^\s*import\s+([\w.]+)"))
    blocks = F.array_join(all_(r"(?m)^import\s*\(([^)]*)\)"), "\n")
    go = F.concat(all_(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.regexp_extract_all(blocks, F.lit('"([^"]+)"'), F.lit(1)))
    return F.sort_array(F.array_distinct(F.when(ext == ".py", python).when(ext == ".go", go).otherwise(script)))


def extract_exports(code: Column, ext: Column) -> Column:
    all_ = lambda p: F.regexp_extract_all(code, F.lit(p), F.lit(1))
    script = all_(r"(?m)^\s*export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)")
    python = all_(r"(?m)^(?:async\s+)?(?:def|class)\s+([A-Za-z]\w*)")
    go = all_(r"(?m)^(?:func(?:\s+\([^)]*\))?|type|var|const)\s+([A-Z]\w*)")
    return F.sort_array(F.array_distinct(F.when(ext == ".py", python).when(ext == ".go", go).otherwise(script)))


def is_exported(name: Column, code: Column, ext: Column) -> Column:
    """Whether a symbol is visible outside its file: a capital in Go, no underscore in front in Python, ``export`` elsewhere."""
    line = F.regexp_extract(code, r"(?m)^([^\n]*\b(?:function\*?|class|interface|enum|const|let|var|type)\s[^\n]*)$", 1)
    return F.when(ext == ".go", name.rlike("^[A-Z]")).when(ext == ".py", (name != "") & ~name.startswith("_")).otherwise((name != "") & line.rlike(r"^\s*export\b"))


def blank_literals(code: Column) -> Column:
    for p in (r"(?s)/\*.*?\*/", r"//[^\n]*", r"'(?:[^'\\\n]|\\.)*'", r'"(?:[^"\\\n]|\\.)*"', r"(?s)`(?:[^`\\]|\\.)*`"):
        code = F.regexp_replace(code, p, "")
    return code


# What raises the risk of a symbol.
BRANCHES = r"\b(?:if|else|switch|case|catch|for|while)\b"
TERNARIES = r"(?<!\?)\?(?!\.|:|\?)"
CALLS = r"\b[a-zA-Z_]\w*\s*\("
CHANGES = r"\+=|-=|\*=|/=|%=|\+\+|--|\.push\(|\.pop\(|\.shift\(|\.unshift\(|\.splice\(|\.set\(|\.delete\(|\.clear\(|\.add\("
ARITHMETIC = r"(?:\w|\]|\))\s*(?:[-+*/%](?![=+*-]))\s*(?:\w|\(|\[)"
BUSINESS_NAMES = "(?i)calculate|validate|process|compute|handle|update|sync|transform|parse|execute|mutate|match"
MONEY_NAMES = "(?i)pnl|price|volume|amount|balance|margin|risk|vwap|liquidation|drawdown|position|order|fill|iceberg|trade"
TYPE_GAPS = r"\bas\s+any\b|:\s*any\b"
# Defects by name, on the source without literals and comments but for the second.
EMPTY_CATCH = r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}"
SUPPRESSED = r"@ts-(?:ignore|expect-error|nocheck)"
ANY_ESCAPES = r"\bas\s+any\b|:\s*any\b|<\s*any\b|,\s*any\b"
NON_NULL = r"\w+![.\[]"


def _counts(clean: Column) -> dict[str, Column]:
    n = lambda p: F.size(F.regexp_extract_all(clean, F.lit(p), F.lit(0)))
    return {"branches": n(BRANCHES) + n(TERNARIES), "calls": n(CALLS), "changes": n(CHANGES), "maths": n(ARITHMETIC)}


def _risk(name: Column, code: Column, lines: Column, clean: Column, n: dict[str, Column]) -> Column:
    step = lambda x, high, a, low, b: F.when(x > high, a).when(x > low, b).otherwise(0)
    size = F.when(lines <= 3, -2).when(lines > 50, 3).when(lines > 20, 1).otherwise(0)
    flag = lambda c, v: F.when(c, v).otherwise(0)
    total = size + step(n["branches"], 6, 3, 2, 1) + flag(n["calls"] > 15, 1) + step(n["changes"], 2, 2, 0, 1) + flag(name.rlike(BUSINESS_NAMES), 2) + flag(name.rlike(MONEY_NAMES), 2) + step(n["maths"], 3, 2, 0, 1) + flag(clean.rlike(TYPE_GAPS), 2)
    return F.when(F.coalesce(code, F.lit("")) == "", "LOW").when(total >= 5, "HIGH").when(total >= 3, "MED").otherwise("LOW")


def _defects(code: Column, clean: Column) -> Column:
    found = F.array(
        F.when(clean.rlike(EMPTY_CATCH), F.lit("swallowed-error")),
        F.when(code.rlike(SUPPRESSED), F.lit("ts-suppress")),
        F.when(clean.rlike(ANY_ESCAPES), F.lit("type-escape-any")),
        F.when(clean.rlike(NON_NULL), F.lit("non-null-assert")),
    )
    return F.array_compact(found)


def triage_risk(name: Column, code: Column, lines: Column) -> Column:
    """HIGH from 5, MED from 3, else LOW, of an additive score over size, branches, calls, changes, names and arithmetic."""
    clean = blank_literals(F.coalesce(code, F.lit("")))
    return _risk(name, code, lines, clean, _counts(clean))


def defects(code: Column) -> Column:
    """Names of the defects that a source shows, the severe ones first."""
    return _defects(code, blank_literals(code))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (with name, code, lines) with risk and defects; each text is blanked, and each pattern counted, once."""
    clean, name, code = F.col("_clean"), F.col("name"), F.col("code")
    rows = rows.withColumn("_clean", blank_literals(F.coalesce(code, F.lit(""))))
    rows = rows.withColumns({f"_{k}": c for k, c in _counts(clean).items()})
    n = {k: F.col(f"_{k}") for k in _counts(clean)}
    return rows.withColumns({"risk": _risk(name, code, F.col("lines"), clean, n), "defects": _defects(code, clean)}).drop("_clean", *(f"_{k}" for k in n))


def normalize_web_symbol(symbol: Column, ext: Column) -> Column:
    """A selector without dots, hashes and commas, a key or an attribute's value without quotes; other symbols as they are."""
    css = F.trim(F.regexp_replace(F.regexp_replace(symbol, r"[.#,]", " "), r"\s+", " "))
    return F.when(ext == ".css", css).when(ext.isin(".json", ".html"), F.trim(F.regexp_replace(symbol, "^[\"']|[\"']$", ""))).otherwise(symbol)


@query("t28_web_symbols", "SELECT p_partkey, 'b' || substr(p_brand, 7) || ' p' || p_partkey || ' x > li' AS css, p_name AS json, p_type AS html, '.' || p_name || ', #x' AS ts FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    selector = F.concat(F.lit(".b"), F.substr("p_brand", F.lit(7)), F.lit(" ,  #p"), key, F.lit(".x\n> li "))
    of = lambda symbol, ext: normalize_web_symbol(symbol, F.lit(f".{ext}")).alias(ext)
    return table(spark, sf_dir, "part").select("p_partkey", of(selector, "css"), of(F.concat(F.lit('"'), "p_name", F.lit('"')), "json"), of(F.concat(F.lit("' "), "p_type", F.lit("'")), "html"), of(F.concat(F.lit("."), "p_name", F.lit(", #x")), "ts"))


@query("t32_path_parts", "SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_extract(url, '[^/]*$') AS base FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.text import basename, dirname

    return table(spark, sf_dir, "pages").select("page_id", dirname(F.col("url")).alias("dir"), basename(F.col("url")).alias("base"))


@query("t33_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


CODE_SQL = "code AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'a.ts' WHEN 1 THEN 'b.py' ELSE 'c.go' END AS path, CASE event_id % 3 WHEN 0 THEN 'import x from ''./m' || user_id || ''';' || chr(10) || 'export function calc' || user_id || '(a) { if (a) { a += 1 } }' WHEN 1 THEN 'from pkg.m' || user_id || ' import y' || chr(10) || 'def run' || user_id || '():' ELSE 'func Get' || user_id || '() {}' END AS code FROM events)"


def sample_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u, nl = F.col("event_id") % 3, F.col("user_id").cast("string"), F.lit("\n")
    code = F.when(k == 0, F.concat(F.lit("import x from './m"), u, F.lit("';"), nl, F.lit("export function calc"), u, F.lit("(a) { if (a) { a += 1 } }"))).when(k == 1, F.concat(F.lit("from pkg.m"), u, F.lit(" import y"), nl, F.lit("def run"), u, F.lit("():"))).otherwise(F.concat(F.lit("func Get"), u, F.lit("() {}")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(k == 0, "a.ts").when(k == 1, "b.py").otherwise("c.go").alias("path"), code.alias("code"))


@query("t22_exports", expected_sql(CODE, "exports"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir, CODE).select("id", F.array_join(extract_exports(F.col("code"), extension(F.col("path"))), ",").alias("exports"))


@query("t23_imports", expected_sql(CODE, "imports"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir, CODE).select("id", F.array_join(extract_imports(F.col("code"), extension(F.col("path"))), ",").alias("imports"))


# Fixed order: a function, a class or the like, a constant that is a function.
NAME_PATTERNS = [r"\b(?:function\*?|def|func)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)", r"\b(?:class|interface|enum)\s+([A-Za-z_$][\w$]*)", r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\(|function\b)"]


def symbol_name(code: Column) -> Column:
    """The first name that a source defines, by patterns tried in this order; empty if none fits."""
    return F.coalesce(*(F.nullif(F.regexp_extract(code, p, 1), F.lit("")) for p in NAME_PATTERNS), F.lit(""))


def file_outline(files: DataFrame) -> DataFrame:
    """id, path, line (from 1), name, kind, exported of the definitions of (id, path, code)."""
    lines = files.select("id", "path", F.posexplode(F.split("code", "\n", -1)).alias("p", "text"))
    rows = lines.withColumn("name", symbol_name(F.col("text"))).where("name <> ''")
    kind = F.when(F.col("text").rlike(NAME_PATTERNS[0]), "func").when(F.col("text").rlike(NAME_PATTERNS[1]), "class").otherwise("const")
    return rows.select("id", "path", (F.col("p") + 1).alias("line"), "name", kind.alias("kind"), is_exported(F.col("name"), F.col("text"), extension(F.col("path"))).alias("exported"))


@query("c4_file_outline", expected_sql(CODE, "outline"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = snippets(spark, sf_dir, CODE)
    rows = file_outline(files).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["name"])), ",")
    return files.select("id").join(rows, "id", "left").select("id", F.coalesce(text, F.lit("")).alias("outline"))


@query("t27_symbol_names", expected_sql(CODE, "name"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = F.regexp_extract("code", NAME_PATTERNS[0], 1)
    return snippets(spark, sf_dir, CODE).select("id", F.when(only != "", symbol_name(F.col("code"))).otherwise("").alias("name"))


@query("c3_export_status", expected_sql(CODE, "exported"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir, CODE).select("id", is_exported(symbol_name(F.col("code")), F.col("code"), extension(F.col("path"))).cast("string").alias("exported"))


@query("r10_outline_risk", expected_sql(CODE, "risk", "defects"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = snippets(spark, sf_dir, CODE)
    lines = F.size(F.split("code", "\n"))
    return c.select("id", triage_risk(F.regexp_extract("code", r"(?:function|def|func) (\w+)", 1), F.col("code"), lines).alias("risk"), F.array_join(defects(F.col("code")), ",").alias("defects"))


@query("t7_light_compression", f"WITH {CODE_SQL} SELECT id, regexp_replace(code, ' +$', '') AS code FROM code")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("/* head\n */"), "code", F.lit("  \n// tail\n\n\n\nconsole.log(1);\ndebugger;"))
    return sample_code(spark, sf_dir).select("id", strip_comments(noisy).alias("code"))


def escape_angles(text: Column) -> Column:
    """For display between tags."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_import(module: Column) -> Column:
    """For display: the last part of a relative path without its extension; other modules as they are."""
    return F.when(module.startswith("."), F.regexp_replace(F.regexp_extract(module, r"([^/]*)$", 1), r"\.(?:js|ts|jsx|tsx|mjs|cjs)$", "")).otherwise(module)


@query("t31_display_forms", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, regexp_replace(url, '^.*/', '') AS short FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.concat(F.lit("./"), F.regexp_replace("url", "^.*/", ""), F.lit(".ts"))
    return table(spark, sf_dir, "pages").select("page_id", escape_angles(F.col("html")).alias("escaped"), short_import(module).alias("short"))
