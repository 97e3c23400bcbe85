"""Functions on source text that regular expressions cannot express, as vectorized UDFs over plain functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexer
from quarry.functions.ship import ship
from quarry.functions.text import extension
from quarry.registry import query
from quarry.sources.corpus import FORMS, PIECES_SQL, source_files
from quarry.sources.snippets import CODE, LITERALS, expected_sql, snippets
from quarry.sources.tables import table

QUOTES = "'\"`"
#: Characters that a head goes over.
_PLAIN = re.compile(r"[^'\"`(\[<)\]>{:=]*")


def _after_string(code: str, at: int) -> int:
    """Where the string that begins at ``at`` ends, or the end of the text."""
    quote, k = code[at], at + 1
    while k < len(code):
        if code[k] == "\\":
            k += 2
        elif code[k] == quote:
            return k + 1
        else:
            k += 1
    return len(code)


def remove_calls(code: str, name: str = r"console\.\w+|print") -> str:
    """Without the calls of a name, whatever their arguments hold; unclosed calls stay."""
    out, at = [], 0
    for m in re.finditer(rf"(?<![\w.])(?:{name})\s*\(", code):
        if m.start() < at:
            continue
        depth, k = 1, m.end()
        while k < len(code) and depth:
            if code[k] in QUOTES:
                k = _after_string(code, k)
                continue
            depth += {"(": 1, ")": -1}.get(code[k], 0)
            k += 1
        if depth:
            break
        end = re.compile(r"[ \t]*;?").match(code, k).end()
        out.append(code[at : m.start()])
        at = end
    return "".join(out) + code[at:]


def signature(code: str) -> str:
    """The head of a definition: up to its body, Python's colon or a lambda's arrow."""
    depth, k, assigned = 0, 0, False
    while (k := _PLAIN.match(code, k).end()) < len(code):
        c = code[k]
        if c in QUOTES:
            k = _after_string(code, k)
            continue
        if c in "([" or c == "<" and re.match(r"[\w\s{\[(]", code[k + 1 : k + 2] or " "):
            depth += 1
        elif c in ")]" or c == ">" and depth and code[k - 1] not in "=-":
            depth -= 1
        elif depth <= 0:
            if c == "{" or c == ":" and code.lstrip().startswith(("def ", "class ", "async def ")) and code[k + 1 : k + 2] in ("", "\n", " "):
                return " ".join(code[:k].split())
            if c == "=":
                if assigned and code[k + 1 : k + 2] == ">" or code[k + 1 : k + 2] == ">":
                    return " ".join(code[: k + 2].split())
                assigned = True
        k += 1
    return " ".join(code.split("\n")[0].split())


# Words that stand before a declaration's own.
MODIFIERS = r"^(?:(?:export|default|declare|public|private|protected|static|abstract|async|readonly|override)\s+)+"


def clean_signature(raw: str) -> str:
    return re.sub(MODIFIERS, "", raw.strip())


def declared_name(raw: str) -> str:
    """The name that a signature declares, without modifiers, keyword, parameters and types."""
    found = re.match(r"(?:(?:function\*?|class|interface|type|enum|const|let|var|def|func|get|set)\s+)*(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)", clean_signature(raw))
    return found[1] if found else ""


# Imports of scripts by braces, by default and by require; of Python; of Go; and modules of Python's own library.
NAMED_IMPORT = r"import\s+(?:type\s+)?\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]"
DEFAULT_IMPORT = r"import\s+(?!\s*\{)(?:\*\s+as\s+)?([a-zA-Z0-9_$]+)\s*(?:,\s*\{[^}]*\})?\s+from\s+['\"]([^'\"]+)['\"]"
REQUIRED = r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*require\(['\"]([^'\"]+)['\"]\)"
PYTHON_FROM = r"(?m)^from\s+([a-zA-Z0-9_.]+)\s+import\s+(?:\(([^)]*)\)|([^#\n]+))"
PYTHON_IMPORT = r"(?m)^import\s+([^#\n]+)"
GO_IMPORTS = r"import\s*\([\s\S]*?\)|import\s+(?:[a-zA-Z0-9_.]+\s+)?[\"'][^\"']+[\"']"
STANDARD = {"os", "sys", "re", "json", "time", "math", "datetime", "typing", "collections", "itertools", "pathlib", "functools", "abc", "asyncio", "logging", "copy", "enum", "hashlib", "random", "string", "threading", "warnings", "io"}


def _renamed(names: str, mark: str = r"\s+as\s+") -> list[tuple[str, str]]:
    """(name, local name) of a list of names, some of them renamed; a type's mark is no part of its name."""
    parts = [re.split(mark, re.sub(r"^type\s+", "", x.strip())) for x in names.split(",") if x.strip()]
    return [(p[0].strip(), p[-1].strip()) for p in parts]


def _members(code: str, packages: dict[str, str], member: str) -> list[tuple[str, str, str]]:
    """What is used of packages: (member, package.member, path hint)."""
    return [(m[1], f"{local}.{m[1]}", hint) for local, hint in packages.items() for m in re.finditer(rf"\b{re.escape(local)}\.({member})", code)]


def _python_dependencies(code: str) -> list[tuple[str, str, str]]:
    found = [(name, local, m[1].split(".")[-1] or m[1]) for m in re.finditer(PYTHON_FROM, code) for name, local in _renamed((m[2] or m[3] or "").replace("\\\n", " "))]
    modules = [(local, module.split(".")[-1]) for m in re.finditer(PYTHON_IMPORT, code) for module, local in _renamed(m[1].replace("\\\n", " "))]
    return [x for x in found + _members(code, {local: hint for local, hint in modules if hint not in STANDARD}, r"[a-zA-Z_]\w*") if len(x[0]) > 2]


def _go_dependencies(code: str) -> list[tuple[str, str, str]]:
    packages = {}
    for block in re.findall(GO_IMPORTS, code):
        inner = re.sub(r"\)\s*$", "", re.sub(r"^import\s*\(?\s*", "", block))
        for alias, path in re.findall(r'(?:([a-zA-Z0-9_.]+)\s+)?"([^"]+)"', inner):
            hint = path.split("/")[-1] or path
            # Packages of the language's own library have no dot in their first part.
            if "." in path.split("/")[0] and (alias or hint) not in ("_", "."):
                packages[alias or hint] = hint
    return _members(code, packages, r"[A-Z]\w*")


def dependencies(code: str, ext: str) -> list[tuple[str, str, str]]:
    """(symbol, local name, path hint) of what a source imports from its own project, each symbol of a path once, the last as it is named.

    Scripts name what they import; of whole modules of Python and packages of Go what is used of them counts.
    """
    if ext == ".py":
        found = _python_dependencies(code)
    elif ext == ".go":
        found = _go_dependencies(code)
    else:
        hint = lambda p: re.sub(r"\.(?:ts|js)x?$", "", p.split("/")[-1]) or p
        found = [(*n, m[2]) for m in re.finditer(NAMED_IMPORT, code) for n in _renamed(m[1])]
        found += [(m[1], m[1], m[2]) for m in re.finditer(DEFAULT_IMPORT, code) if m[1] != "type"]
        found += [(*n, m[2]) for m in re.finditer(REQUIRED, code) for n in _renamed(m[1], r"\s*:\s*")]
        found = [(name, local, hint(path)) for name, local, path in found if len(name) > 2 and path[0] in "./~@"]
    return list({(x[0], x[2]): x for x in found}.values())


def shorthand(kind: str, code: str, first: int, last: int) -> str:
    """``[kind] signature`` with the place of the body; two lines or fewer stay whole."""
    return f"[{kind}] {code}" if code.count("\n") < 2 else f"[{kind}] {signature(code)} {{ /* L{first}-L{last} */ }}"


# Types that say nothing, in TypeScript, Python and Go.
TOXIC_TYPES = r"\b(?:any|unknown|Function|object|Any)\b|\binterface\{\}"


def regressed(before: str, after: str) -> bool:
    """Whether a signature lost a type: it came to hold one that says nothing, or lost an annotation or a result."""
    toxic = lambda s: len(re.findall(TOXIC_TYPES, s))
    typed = lambda s: len(re.findall(r":\s*\w|->\s*\w", s))
    return toxic(after) > toxic(before) or typed(after) < typed(before)


def apply(spark: SparkSession, f: Callable, kind: str, *cols: Column) -> Column:
    """A plain function of strings as a vectorized column; a null argument gives null."""
    ship(spark)

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    return run(*cols)


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.functions.code import sample_code

    return sample_code(spark, sf_dir)


@query("t8_call_removal", "SELECT doc_id, 'a;' || chr(10) || text || chr(10) || chr(10) || doc_id || ';' AS code FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text is an argument's neighbour, so its own quotes and brackets must come through.
    noisy = F.concat(F.lit("a;\nconsole.log('x)', (1 + (2)));"), "text", F.lit("\nprint(\"it's (\");"), F.lit("\n"), F.col("doc_id").cast("string"), F.lit(";"))
    noisy = F.replace(noisy, F.lit("\n\n"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", apply(spark, remove_calls, "string", noisy).alias("code"))


@query("t19_blank_literals", expected_sql(LITERALS, "blank"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir, LITERALS).select("id", apply(spark, lexer.blank, "string", F.col("code"), extension(F.col("path"))).alias("blank"))


@query("t20_signatures", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'import x from ''./m' || user_id || ''';' || ' export function calc' || user_id || '(a)' WHEN 1 THEN 'def run' || user_id || '()' ELSE 'func Get' || user_id || '()' END AS sig FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.regexp_replace("code", r"^from [^\n]*\n", "")
    return _code(spark, sf_dir).select("id", apply(spark, signature, "string", code).alias("sig"))


@query("t24_dependencies", expected_sql(CODE, "dependencies"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c, p: ",".join(">".join(x) for x in dependencies(c, p))
    files = snippets(spark, sf_dir, CODE)
    return files.select("id", apply(spark, listed, "string", F.col("code"), extension(F.col("path"))).alias("dependencies"))


_LOCAL_FORMS = ", ".join(str(k) for k, f in enumerate(FORMS) if f[0] in "./~@")


@query("t24_source_dependencies", f"""WITH {PIECES_SQL}, d AS (
  SELECT DISTINCT 'src/n' || k.c_nationkey || '/c' || l.c || '.ts' AS path, 'order' || p AS symbol, 'o' || p AS local, 'c' || pc AS hint FROM links l JOIN customer k ON k.c_custkey = l.c WHERE pc <> l.c AND o % {len(FORMS)} IN ({_LOCAL_FORMS})
  UNION ALL SELECT 'app/n' || a.s_nationkey || '/s' || a.s_suppkey || '.py', 'part' || (1000 + b.s_suppkey), 'p' || (1000 + b.s_suppkey), 's' || b.s_suppkey FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey // 3)
  SELECT path, list_sort(list(symbol || '>' || local || '>' || hint)) AS dependencies FROM d GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c, p: ",".join(sorted(">".join(x) for x in dependencies(c, p)))
    files = source_files(spark, sf_dir)
    found = files.select("path", apply(spark, listed, "string", F.col("code"), extension(F.col("path"))).alias("l"))
    return found.where("l <> ''").select("path", F.split("l", ",").alias("dependencies"))


@query("t26_shorthand", expected_sql(CODE[:4], "shorthand"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = snippets(spark, sf_dir, CODE[:4])
    short = apply(spark, lambda k, c: shorthand(k, c, 1, 1 + c.count("\n")), "string", F.ltrim(extension(F.col("path")), F.lit(".")), F.col("code"))
    return files.select("id", short.alias("shorthand"))


# Signatures before and after, and whether a type was lost.
CHANGES = [
    ("f(a: number): string", "f(a: any): string", True),
    ("f(a: number): string", "f(a: number): number", False),
    ("f(a: number): string", "f(a): string", True),
    ("def f(a: int) -> str", "def f(a: int)", True),
    ("def f(a: int) -> str", "def f(a: int) -> Any", True),
    ("def f(a)", "def f(a: int)", False),
    ("func F(a int) string", "func F(a interface{}) string", True),
    ("func F(a int) string", "func F(a int, b int) string", False),
]


@query("t29_signature_regressions", "SELECT o_orderkey, o_orderkey % 8 IN (0, 2, 3, 4, 6) AS regressed FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("o_orderkey") % len(CHANGES) + 1).cast("int")
    side = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in CHANGES)), at)
    return table(spark, sf_dir, "orders").select("o_orderkey", apply(spark, regressed, "boolean", side(0), side(1)).alias("regressed"))


@query("r16_refactoring_preview", expected_sql(CODE, "occurrences"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which lines x would be renamed, and whether all its places there are sure."""

    def listed(code: str, ext: str) -> str:
        lines: dict[int, str] = {}
        for _, line, _, how in lexer.occurrences(code, {"x"}, ext):
            lines[line] = "review" if "review" in (how, lines.get(line)) else how
        return ",".join(f"{n}:{how}" for n, how in lines.items())

    return snippets(spark, sf_dir, CODE).select("id", apply(spark, listed, "string", F.col("code"), extension(F.col("path"))).alias("occurrences"))
