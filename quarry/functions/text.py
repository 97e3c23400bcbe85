"""Text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the index leaves out.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "and", "but", "or", "not", "no", "if", "then",
    "else", "this", "that", "it", "its", "new", "old",
]


def split_identifier(identifier: Column) -> Column:
    """Lower-cased parts of a camel-case, snake-case or dotted identifier, each once.

    Acronyms end before a capitalized word: getAPIResponse gives get, api, response.
    """
    cut = F.regexp_replace(identifier, "([A-Z]{2,})([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.transform(F.regexp_extract_all(cut, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), F.lower))


def tokenize(text: Column) -> Column:
    """Index terms in order: parts of the identifiers of a text, without stop words and single characters."""
    words = F.filter(F.split(F.regexp_replace(text, "[^a-zA-Z0-9_.]", " "), " +"), lambda w: F.length(w) > 1)
    stop = [F.lit(w) for w in STOPWORDS]
    # Most words are plain; only the others need to be taken apart.
    parts = lambda w: F.when(w.rlike("^[A-Z]?[a-z]+$"), F.array(F.lower(w))).otherwise(split_identifier(w))
    return F.filter(F.flatten(F.transform(words, parts)), lambda t: (F.length(t) > 1) & ~t.isin(*stop))


_STOP_SQL = ",".join(f"'{w}'" for w in STOPWORDS)


def tokenize_sql(text: str) -> str:
    """The same for DuckDB."""
    clean = f"regexp_replace({text}, '[^a-zA-Z0-9_.]', ' ', 'g')"
    words = f"list_filter(regexp_split_to_array({clean}, ' +'), lambda w: length(w) > 1)"
    parts = "list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]{2,})([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
    once = f"list_transform(list_transform({words}, lambda w: {parts}), lambda l: list_filter(l, lambda p, i: list_position(l, p) = i))"
    return f"list_filter(flatten({once}), lambda t: length(t) > 1 AND t NOT IN ({_STOP_SQL}))"


def identifiers(code: Column) -> Column:
    """Distinct identifiers of a text."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit("[a-zA-Z_$][a-zA-Z0-9_$]*"), F.lit(0)))


def token_estimate(text: Column, prose: bool = False) -> Column:
    return F.ceil(F.length(text) / F.lit(4.0 if prose else 3.5)).cast("long")


def regex_escape(s: str) -> str:
    """A pattern that matches ``s`` itself, for Java and RE2 alike."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)


def has_symbol(code: Column, symbol: str) -> Column:
    """Whether ``symbol`` stands alone: no letter, digit, underscore or dollar next to it."""
    return code.rlike(r"(^|[^a-zA-Z0-9_$])" + regex_escape(symbol) + r"($|[^a-zA-Z0-9_$])")


def path_boost(path: Column) -> Column:
    """First rule that holds on the lower-cased path with forward slashes."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    has = lambda *parts: p.rlike("|".join(map(regex_escape, parts)))
    return F.when(has("node_modules"), 0.3).when(has("/dist/", "/build/"), 0.5).when(has("test"), 0.7).when(has("/src/"), 1.2).when(has("/lib/", "/core/"), 1.1).otherwise(1.0)


PATH_BOOST_SQL = "CASE WHEN lower(path) LIKE '%node_modules%' THEN 0.3 WHEN lower(path) LIKE '%/dist/%' OR lower(path) LIKE '%/build/%' THEN 0.5 WHEN lower(path) LIKE '%test%' THEN 0.7 WHEN lower(path) LIKE '%/src/%' THEN 1.2 WHEN lower(path) LIKE '%/lib/%' OR lower(path) LIKE '%/core/%' THEN 1.1 ELSE 1.0 END"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]|\x1b\][^\x07]*\x07|\x1b[()][A-Z0-9]|\x1b[=>]", "")


def _chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


_ALWAYS = [("(?i)0x[a-f0-9]+", "0xADDR"), (r"[0-9]{13,}", "TIMESTAMP")]
_LIBRARY = [(r":[0-9]+:[0-9]+", ":L:C"), *_ALWAYS, (r":[0-9]+\)", ":N)")]


def normalize_line(line: Column) -> Column:
    """A key under which lines that differ in addresses and times are equal; in library frames also in places."""
    library = line.contains("node_modules") | line.contains("internal/") | line.contains("<anonymous>")
    return F.trim(F.when(library, _chain(line, _LIBRARY)).otherwise(_chain(line, _ALWAYS)))


def error_fingerprint(text: Column) -> Column:
    """16 hex digits that don't depend on times, places and addresses in an error text."""
    rules = [
        (r"\x1b\[[0-9;]*[A-Za-z]", ""),
        (r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?", "[TIME]"),
        (r":[0-9]+:[0-9]+", ":[L]:[C]"),
        (r"(?i)line [0-9]+", "line N"),
        (r"[0-9]{13,}", "[TS]"),
        (r"(?i)0x[a-f0-9]+", "[MEM]"),
    ]
    return F.substring(F.sha2(F.trim(_chain(text, rules)), 256), 1, 16)


# Patterns of which one, or two, tell an error.
STRONG_ERRORS = [r"(?i)error\s+TS\d+", r"(?im)npm\s+(?:ERR!|error)", r"(?m)^\s*(?:FAIL|✕|×|✗)\s+", r"ExitCode:\s*[1-9]", r"Process exited with code [1-9]", r"(?i)Command failed", r"(?i)Build failed", r"(?i)Tests?\s+failed"]
WEAK_ERRORS = [r"(?m)^\w*Error:", r"SyntaxError:", r"TypeError:", r"ReferenceError:", r"Cannot find module", r"ENOENT"]


def contains_error(text: Column) -> Column:
    weak = sum((text.rlike(p).cast("int") for p in WEAK_ERRORS), F.lit(0))
    return text.rlike("|".join(f"(?:{p})" for p in STRONG_ERRORS)) | (weak >= 2)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With the dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k
