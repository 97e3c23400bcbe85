"""Compression of source text: preprocessing, scoring and pruning of words, bodies as stubs.

All three work on one text at a time, so they are plain functions in Arrow batches; the only
thing that is gathered from a corpus is a bounded table of its common words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexer
from quarry.functions.ship import ship
from quarry.functions.structure import remove_calls, shorthand
from quarry.registry import query
from quarry.sources.corpus import CHUNKS_OF_SOURCES_SQL, SOURCES_SQL, source_files
from quarry.sources.snippets import CODE, expected_sql, snippets
from quarry.sources.tables import spread, table

# What pruning never removes, words that protect themselves and the next one,
# the probability of words that are not common, and by level the share removed and alpha.
OPERATORS = r"[{}()\[\];:,=<>!&|+\-*/%^~?@#]|=>|\.\.\."
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
KEYWORDS = ["function", "class", "interface", "type", "import", "export", "return", "throw", "await", "const", "let", "var", "new", "extends", "implements", "from", "as", "enum", "def", "func", "struct", "package", "async", "yield"]
RARE = 1e-4
LEVELS = {"light": (0.10, 0.5), "medium": (0.30, 0.5), "aggressive": (0.50, 0.7)}
#: A word is common from this share of all words on, so there are at most 1,000 such words.
COMMON = 1e-3
# Names that look like calls and are none, and key references at most.
NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "throw", "new", "await", "function", "class"}
KEY_REFERENCES = 5
# Console methods whose calls go.
CONSOLE = "log|warn|error|debug|info|assert|trace|dir|table|time|timeEnd|group|groupEnd"

_SPACE = " \t\n\r\f\v"
_WORDS = re.compile(f"[^{_SPACE}]+")
_KEPT = re.compile(rf"^(?:{OPERATORS}|{NUMBER})$|^[A-Z]|[.()]")
_PYTHON = re.compile(r'("""|\'\'\')[\s\S]*?\1|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*')
_SCRIPT = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*")


def preprocess(code: str, ext: str) -> str:
    """Without comments, docstrings, console and print statements, debugger statements and surplus white space."""
    if ext == ".py":
        shebang = re.match(r"#![^\n]*\n?", code)
        head, rest = (shebang[0], code[shebang.end() :]) if shebang else ("", code)
        code = head + _PYTHON.sub(lambda m: m[1][0] * 2 if m[1] else "" if m[0][0] == "#" else m[0], rest)
    else:
        code = _SCRIPT.sub("", code)
    code = remove_calls(code, rf"(?<![^\n])[ \t]*console\.(?:{CONSOLE})")
    if ext == ".py":
        code = remove_calls(code, r"(?<![^\n])[ \t]*print")
    code = re.sub(r"\bdebugger[ \t]*;?", "", code)
    code = re.sub(r"(?m)[ \t]+$", "", code)
    code = re.sub(r"\n{3,}", "\n\n", code)
    return re.sub(r"\n+$", "\n", code.lstrip("\n"))


def scored(text: str, alpha: float, common: dict[str, float]) -> list[tuple[int, int, float, bool]]:
    """Start, end, score and protection of the words of a text.

    A word scores ``alpha`` times its self-information plus the rest times its frequency in the text, relative to the most
    frequent word's, times how rare it is among the text's different words.  Keywords, and words after one, on any line, are protected.
    """
    found = list(_WORDS.finditer(text))
    keys = [m[0].lower() for m in found]
    times = Counter(keys)
    most = max(times.values(), default=1)
    value = {k: round(alpha * -math.log2(common.get(k, RARE)) + (1 - alpha) * (n / most) * math.log2(1 + len(times) / n), 9) for k, n in times.items()}
    names = set(KEYWORDS)
    after = [False, *(k in names for k in keys[:-1])]
    return [(m.start(), m.end(), value[k], bool(_KEPT.search(m[0])) or k in names or a) for m, k, a in zip(found, keys, after, strict=False)]


def kept_words(words: list[tuple[int, int, float, bool]], share: float) -> list[tuple[int, int, float, bool]]:
    """Protected words, and the others from element floor(n share) of their sorted scores on."""
    free = sorted(w[2] for w in words if not w[3])
    least = free[math.floor(len(free) * share)] if free else -math.inf
    return [w for w in words if w[3] or w[2] >= least]


def prune(text: str, share: float, alpha: float, common: dict[str, float]) -> str:
    """The kept words with the white space that stood before them; runs of blanks become one."""
    out, at = [], 0
    words = scored(text, alpha, common)
    keep = {w[0] for w in kept_words(words, share)}
    for start, end, *_ in words:
        out.append(text[at:start])
        if start in keep:
            out.append(text[start:end])
        at = end
    joined = re.sub(r" *\n *", "\n", "".join([*out, text[at:]]))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"  +", " ", joined)).strip()


def key_references(code: str) -> list[str]:
    """Names that are called, then modules that are imported from, each once, five at most."""
    calls = (n for n in re.findall(r"\b([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)\s*\(", code) if n not in NO_CALLS)
    return list(dict.fromkeys([*calls, *re.findall(r"from\s+[\"']([^\"']+)[\"']", code)]))[:KEY_REFERENCES]


# Lines before the first definition that stay, and lines of a body that tell what it does, by how they begin and by what they hold.
HEAD_LINES = ("import", "export", "type ", "interface ", "from ", "package ", "require")
KEY_BEGINNINGS = ("return ", "throw ", "await ", "yield ", "if (", "for (", "while (")
KEY_PARTS = ("= new ", "this.")
KEY_LINES = 5


def is_key_line(line: str) -> bool:
    return line.startswith(KEY_BEGINNINGS) or any(p in line for p in KEY_PARTS) or line.startswith("const ") and "=" in line


def signatures_and_key_lines(code: str, ext: str) -> tuple[str, int]:
    """The imports, and of every definition its shorthand and its first key lines; and how many definitions there are."""
    found = lexer.chunks(code, ext)
    if not found:
        return code, 0
    lines = code.split("\n")
    first = lexer.lines_of(code, [c[2] for c in found])
    out = [x for x in lines[: min(first) - 1] if x.strip().startswith(HEAD_LINES)]
    for (kind, _, start, end), line in zip(found, first, strict=True):
        own = code[start:end]
        out.append(shorthand(kind, own, line, line + own.count("\n")))
        key = [x.strip() for x in own.split("\n") if is_key_line(x.strip())][:KEY_LINES]
        out += ["  // Key lines:", *(f"  {x}" for x in key)] if key else []
    return "\n".join(out), len(found)


def stubs(code: str, ext: str) -> tuple[str, int]:
    """The source with a stub in the place of each outer definition that is longer than that; and how many definitions there are.

    A stub is the shorthand, the number of lines and the key references.
    """
    found = lexer.chunks(code, ext)
    out, at = [], 0
    for (kind, _, start, end), line in zip(found, lexer.lines_of(code, [c[2] for c in found]), strict=True):
        if start < at:
            continue
        own = code[start:end]
        refs = key_references(own)
        stub = f"{shorthand(kind, own, line, line + own.count(chr(10)))}\n/*[{own.count(chr(10)) + 1}L{' refs:' + ','.join(refs) if refs else ''}]*/"
        out += [code[at:start], stub if len(stub) < len(own) else own]
        at = end
    return "".join(out) + code[at:], len(found)


def structure(code: str, ext: str, level: str, path: str) -> str:
    """What the structural stage of a level makes of a source; a source without definitions stays."""
    text, n = (stubs if level == "aggressive" else signatures_and_key_lines)(code, ext)
    return f"// {path} | {level} | {n} chunks\n{text}" if n else code


def compress(code: str, ext: str, level: str, common: dict[str, float], path: str = "") -> str:
    """``light`` preprocesses; ``medium`` and ``aggressive`` prune words too, and take the structure of the source instead where that is shorter."""
    clean = preprocess(code, ext)
    if level == "light":
        return clean
    share, alpha = LEVELS[level]
    return min(prune(clean, share, alpha, common), structure(code, ext, level, path), key=len)


def common_words(docs: DataFrame, text_col: str) -> dict[str, float]:
    """Words with at least ``COMMON`` of all words of the corpus, and their shares: at most 1,000."""
    words = docs.select(F.explode(F.split(text_col, f"[{_SPACE}]+")).alias("w")).where("w <> ''").groupBy(F.lower("w").alias("k")).agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n").alias("all"))
    shares = words.crossJoin(F.broadcast(total)).select("k", (F.col("n") / F.col("all")).alias("p"))  # one row
    return {r["k"]: r["p"] for r in shares.where(F.col("p") >= COMMON).collect()}


def prune_documents(docs: DataFrame, id_col: str, text_col: str, share: float, alpha: float, common: dict[str, float] | None = None) -> DataFrame:
    """id, words, kept, text, digest (of the kept words) of every row; nothing is shuffled.

    ``common`` gives the probabilities of common words, by default those of the corpus.
    """
    known = common_words(docs, text_col) if common is None else common
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = scored(text or "", alpha, known)
                kept = kept_words(words, share)
                digest = hashlib.md5(" ".join(text[a:b] for a, b, *_ in kept).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(words), len(kept), prune(text or "", share, alpha, known), digest))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["id", "words", "kept", "text", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "id long, words long, kept long, text string, digest string")


def _extension(path: str | None) -> str:
    found = re.search(r"\.[^./]*$", path or "")
    return found[0].lower() if found else ""


def structure_files(files: DataFrame, level: str) -> DataFrame:
    """path, text: the structure of (path, code) at a level, whether or not it is shorter."""
    ship(files.sparkSession)

    @F.arrow_udf("string")
    def run(codes: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([None if c is None else structure(c, _extension(p), level, p or "") for c, p in zip(codes.to_pylist(), paths.to_pylist(), strict=True)], pa.string())

    return files.select("path", run("code", "path").alias("text"))


def compress_files(files: DataFrame, level: str, common: dict[str, float] | None = None) -> Column:
    """A column of the compressed ``code`` of files with ``path``."""
    known = common_words(files, "code") if common is None and level != "light" else common or {}
    ship(files.sparkSession)

    @F.arrow_udf("string")
    def run(codes: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([None if c is None else compress(c, _extension(p), level, known, p or "") for c, p in zip(codes.to_pylist(), paths.to_pylist(), strict=True)], pa.string())

    return run("code", "path")


def _prune_sql(share: float, alpha: float, given: dict[str, float] | None = None) -> str:
    shares = f"SELECT k, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY 1 HAVING p >= {COMMON}"
    if given is not None:
        shares = f"SELECT * FROM (VALUES {', '.join(f"('{k}', {p})" for k, p in given.items())}) v(k, p)"
    names = ", ".join(f"'{k}'" for k in KEYWORDS)
    return rf"""WITH x AS (SELECT doc_id AS id, unnest(l) AS w, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\r\f\v]+') AS l FROM documents)),
  t AS (SELECT id, pos, w, lower(w) AS k FROM x WHERE w <> ''),
  c AS ({shares}),
  own AS (SELECT id, k, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT id, max(tf) AS top, count(*) AS u FROM own GROUP BY 1),
  s AS (SELECT t.id, pos, w, round({alpha} * -log2(coalesce(p, {RARE})) + {1 - alpha} * (tf / top) * log2(1 + u / tf), 9) AS s,
          regexp_matches(w, '^(?:{OPERATORS}|{NUMBER})$|^[A-Z]|[.()]') OR k IN ({names}) OR coalesce(lag(k) OVER (PARTITION BY t.id ORDER BY pos) IN ({names}), false) AS safe
        FROM t JOIN own USING (id, k) JOIN d USING (id) LEFT JOIN c USING (k)),
  q AS (SELECT id, list_sort(list(s) FILTER (WHERE NOT safe))[CAST(floor(count(*) FILTER (WHERE NOT safe) * {share}) AS BIGINT) + 1] AS least, count(*) AS words FROM s GROUP BY 1),
  r AS (SELECT id, any_value(words) AS words, count(*) FILTER (WHERE safe OR s >= least) AS kept, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE safe OR s >= least) AS l FROM s JOIN q USING (id) GROUP BY 1)
  SELECT doc_id AS id, coalesce(words, 0) AS words, coalesce(kept, 0) AS kept, md5(coalesce(l, '')) AS digest FROM documents LEFT JOIN r ON doc_id = id"""


@query("t9_medium_pruning", _prune_sql(0.30, 0.5))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prune_documents(docs, "doc_id", "text", *LEVELS["medium"]).select("id", "words", "kept", "digest")


#: Probabilities as a caller may give them, of words that the documents hold and of some that they don't.
_GIVEN = {"the": 0.06, "of": 0.03, "and": 0.028, "in": 0.02, "der": 0.01, "le": 0.009, "que": 0.008, "nowhere": 0.5}


@query("t9_given_probabilities", _prune_sql(0.30, 0.5, _GIVEN))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prune_documents(docs, "doc_id", "text", *LEVELS["medium"], common=_GIVEN).select("id", "words", "kept", "digest")


@query("t11_aggressive_pruning", _prune_sql(0.50, 0.7))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prune_documents(docs, "doc_id", "text", *LEVELS["aggressive"]).select("id", "words", "kept", "digest")


@query("r12_light_level", expected_sql(CODE, "light"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = snippets(spark, sf_dir, CODE)
    return files.select("id", compress_files(files, "light").alias("light"))


# The shorthand of a definition of a derived file, known from its text.
_SHORTHAND = """'[' || kind || '] ' || CASE WHEN last_line - first_line < 2 THEN code ELSE CASE WHEN kind = 'class' THEN regexp_extract(code, '^(export class \\w+)', 1) WHEN name LIKE 'process%' THEN 'export function ' || name || '(v: any)' ELSE 'export async function ' || name || '(total: number, at = "{")' END || ' { /* L' || first_line || '-L' || last_line || ' */ }' END"""
_MEDIUM_SQL = f"""WITH {CHUNKS_OF_SOURCES_SQL},
c AS (SELECT path, start, {_SHORTHAND} || CASE WHEN name LIKE 'order%' OR name LIKE 'process%' THEN chr(10) || '  // Key lines:' || chr(10) || '  ' || trim(string_split(code, chr(10))[2]) || chr(10) || '  ' || trim(string_split(code, chr(10))[3])
    WHEN name LIKE 'local%' THEN chr(10) || '  // Key lines:' || chr(10) || '  ' || code ELSE '' END AS t FROM source_chunks WHERE path LIKE '%.ts'),
i AS (SELECT path, string_agg(rtrim(text, chr(10)), chr(10) ORDER BY seq) AS head FROM pieces WHERE path LIKE '%.ts' AND text LIKE 'import %' GROUP BY 1)
SELECT path, concat_ws(chr(10), '// ' || path || ' | medium | ' || count(*) || ' chunks', any_value(head), string_agg(t, chr(10) ORDER BY start)) AS text FROM c LEFT JOIN i USING (path) GROUP BY 1"""
_AGGRESSIVE_SQL = f"""WITH {CHUNKS_OF_SOURCES_SQL},
c AS (SELECT path, name, {_SHORTHAND} || chr(10) || '/*[4L refs:' || CASE WHEN kind = 'class' THEN 'label' WHEN name LIKE 'process%' THEN name || ',v.push' ELSE concat_ws(',', name, nullif(regexp_extract(code, ' (o\\w+)\\(total\\)', 1), '')) END || ']*/' || chr(10) AS t
  FROM source_chunks WHERE path LIKE '%.ts' AND (kind = 'class' OR name LIKE 'order%' OR name LIKE 'process%')),
n AS (SELECT path, count(*) AS n FROM source_chunks GROUP BY 1)
SELECT p.path, '// ' || p.path || ' | aggressive | ' || any_value(n) || ' chunks' || chr(10) || string_agg(coalesce(t, text), '' ORDER BY seq) AS text FROM pieces p LEFT JOIN c ON c.path = p.path AND c.name = p.name0 JOIN n ON n.path = p.path WHERE p.path LIKE '%.ts' GROUP BY 1"""


@query("r12_medium_structure", _MEDIUM_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_files(source_files(spark, sf_dir).where(F.col("path").endswith(".ts")), "medium")


@query("r12_aggressive_structure", _AGGRESSIVE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_files(source_files(spark, sf_dir).where(F.col("path").endswith(".ts")), "aggressive")


@query("r12_light_sources", rf"""WITH {SOURCES_SQL} SELECT path, regexp_replace(regexp_replace(code, ' // [^\n]*', '', 'g'), ' /\* }} \*/', '', 'g') AS text FROM sources WHERE path LIKE '%.ts'""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir).where(F.col("path").endswith(".ts"))
    return files.select("path", compress_files(files, "light").alias("text"))


@query("t25_key_references", expected_sql(CODE, "references"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.regexp_extract_all("code", F.lit(r"\b([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)\s*\("), F.lit(1))
    named = F.array_except(calls, F.array(*map(F.lit, sorted(NO_CALLS))))
    both = F.array_distinct(F.concat(named, F.regexp_extract_all("code", F.lit(r"from\s+[\"']([^\"']+)[\"']"), F.lit(1))))
    return snippets(spark, sf_dir, CODE).select("id", F.array_join(F.slice(both, 1, KEY_REFERENCES), ",").alias("references"))
