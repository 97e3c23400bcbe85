"""Source files derived from the driver tables, and what is in them, known from the tables.

A customer is a TypeScript file of its orders, a supplier a Python module, a nation a Go file, a
brand a style sheet, an order a JSON document.  A file is made of pieces; a piece knows its text and
the definitions in it, so where each definition lies in the file follows from the lengths of the pieces before it, and
not from reading the file.  The pieces are one SQL text, which Spark and the checking engine
both run; texts hold braces in strings, comments and templates.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

TABLES = ["customer", "orders", "supplier", "part", "nation", "lineitem"]


def _text(template: str, blank: bool = False) -> str:
    """SQL for a text in which ``<name>`` stands for a column; what stands between « and » is a literal, blank if asked."""
    if blank:
        pieces = re.split(r"«([^»]*)»", template)
        sql = [_text(p) if k % 2 == 0 else " || chr(10) || ".join(f"repeat(' ', length({_text(line)}))" if line else "''" for line in p.split("\n")) for k, p in enumerate(pieces) if p]
        return "(" + " || ".join(sql) + ")"
    template = template.replace("«", "").replace("»", "")
    parts = re.split(r"(<\w+>|\n|'|\$)", template)  # a dollar before a brace would be a variable to Spark
    sql = []
    for p in parts:
        if p == "\n":
            sql.append("chr(10)")
        elif p in ("'", "$"):
            sql.append(f"chr({ord(p)})")
        elif re.fullmatch(r"<\w+>", p):
            sql.append(f"CAST({p[1:-1]} AS STRING)")
        elif p:
            sql.append(f"'{p}'")
    return "(" + " || ".join(sql) + ")"


# An order's parent is the order of half its key; what calls it is imported if it is another customer's.
_LINKS = """links AS (
  SELECT o.o_orderkey AS o, o.o_custkey AS c, p.o_orderkey AS p, p.o_custkey AS pc, k.c_nationkey AS pn, o.o_orderpriority AS priority, CAST(floor(o.o_totalprice) AS BIGINT) AS price
  FROM orders o JOIN orders p ON p.o_orderkey = CAST(floor(o.o_orderkey / 2) AS BIGINT) JOIN customer k ON k.c_custkey = p.o_custkey)"""
#: The forms of an import that a resolver must tell apart, by the order's key modulo their number; the last is another project's.
FORMS = ["../n<pn>/c<pc>", "@/n<pn>/c<pc>.ts", "n<pn>/c<pc>", "./../n<pn>/./c<pc>.js", "@team/n<pn>/c<pc>", "github.com/org/app/n<pn>/c<pc>", "n<pn>.c<pc>", "src/n<pn>/c<pc>", "left-pad"]
_FORM = f"CASE o % {len(FORMS)} " + " ".join(f"WHEN {k} THEN {_text(f)}" for k, f in enumerate(FORMS)) + " END"
_HEAD = "import { order<p> as o<p> } from "
_IMPORT = f"{_text(_HEAD)} || chr(39) || form || chr(39) || {_text(';' + chr(10))} AS text, {_text(_HEAD)} || repeat(' ', length(form) + 2) || {_text(';' + chr(10))} AS blank"
_CALL = f"CASE WHEN pc = c AND p <> o THEN {_text('order<p>(total)')} WHEN pc <> c AND o % {len(FORMS)} <> {len(FORMS) - 1} THEN {_text('o<p>(total)')} ELSE 'total' END"
_CLASS = """export class Customer<c> {
  static async label(x?: string): Promise<{ a: string }> { return «`#${»«'{'» + «"}"»«} ${»x«}`»; } «// é }»
  plain = 1;
}
"""
_ORDER = """export async function order<o>(total: number, at = «"{"») { «// <priority> é }»
  const s = «`a ${» [{ b: «`}`» }][0].b «} { ${» total > 1 ? <call> : «'}'» «}`»;
  return s; «/* } */»
}
"""
_LOCAL = "const local<o> = (x: number) => x + order<o>(x)<stop>\n"
_LIMIT = "export const LIMIT<o>: number = <price>;\n"
_SHAPE = "interface Shape<o> { a: number; b: «'}'» }\n"
_RISKY = """export function processPrice<o>(v: any) {
  for (const row of v) { if (row) { v.push(row * 2); } }
  return v.net * v.tax - v.due / 2;
}
"""
_MODULE = "from app.n<pn>.s<ps> import part<pk> as p<pk>\n"
_SUPPLIER = '''class Supplier<s>(Base):
    «"""A class
def no(): pass
    """»
    def total(self, x=(1,
2)):  «# )»
        return «"}"» + «':'»

def part<k>(x):
    return p<k>(x)

'''
_NATION = """package main
import «"fmt"»
«// func No() {»
type Nation<n> struct {
	name string
}
func (r *Nation<n>) Name(x interface{}) string {
	return «`}`» + «"}"»
}
func Region<n>() int { return <r> }
"""
_BRAND = """.b<b>, #p<k> > a { width: <size>px; content: «"}"»; } «/* .no { } */»
@media (max-width: <size>px) { .in<k> { color: red; } }
@keyframes spin<k> { from { width: 1px } to { width: <size>px } }
"""


#: Up to four definitions of a piece: kind, name, the text before it in the piece, and its own text.
_DEFS = {
    "class": [("class", "Customer<c>", "", _CLASS[:-1]), ("method", "label", "export class Customer<c> {\n  ", _CLASS.split("\n")[1][2 : -len(" «// é }»")])],
    "order": [("func", "order<o>", "", _ORDER[:-1])],
    "local": [("func", "local<o>", "", _LOCAL[:-1])],
    "limit": [("var", "LIMIT<o>", "", _LIMIT[:-1])],
    "shape": [("interface", "Shape<o>", "", _SHAPE[:-1])],
    "risky": [("func", "processPrice<o>", "", _RISKY[:-1])],
    "supplier": [("class", "Supplier<s>", "", _SUPPLIER[: _SUPPLIER.index("\n\ndef part")]), ("func", "total", _SUPPLIER[: _SUPPLIER.index("def total")], _SUPPLIER[_SUPPLIER.index("def total") : _SUPPLIER.index("\n\ndef part")]), ("func", "part<k>", _SUPPLIER[: _SUPPLIER.index("def part")], _SUPPLIER[_SUPPLIER.index("def part") : -2])],
    "nation": [("type", "Nation<n>", _NATION[: _NATION.index("type")], _NATION[_NATION.index("type") : _NATION.index("\nfunc (")]), ("method", "Name", _NATION[: _NATION.index("func (")], _NATION[_NATION.index("func (") : _NATION.index("\nfunc Region")]), ("func", "Region<n>", _NATION[: _NATION.index("func Region")], _NATION[_NATION.index("func Region") : -1])],
    "brand": [("class", "b<b> p<k> > a", "", _BRAND[: _BRAND.index(" «/*")]), ("class", "(max-width: <size>px)", _BRAND[: _BRAND.index("@media")], _BRAND.split("\n")[1]), ("class", "in<k>", _BRAND[: _BRAND.index(".in")], _BRAND.split("\n")[1][_BRAND.split("\n")[1].index(".in") : -2]), ("class", "spin<k>", _BRAND[: _BRAND.index("@keyframes")], _BRAND.split("\n")[2])],
}


def _piece(kind: str, path: str, seq: str, text: str, source: str) -> str:
    """One row a piece; without a template the text is a column of the source."""
    defs = _DEFS.get(kind, [])
    cols = [f"{_text(path)} AS path", f"{seq} AS seq", f"{_text(text) if text else 'text'} AS text", f"{_text(text, True) if text else 'blank'} AS blank"]
    for k in range(4):
        if k < len(defs):
            how, name, before, own = defs[k]
            cols += [f"'{how}' AS kind{k}", f"{_text(name)} AS name{k}", f"{_text(before) if before else chr(39) * 2} AS before{k}", f"{_text(own)} AS own{k}"]
        else:
            cols += [f"CAST(NULL AS STRING) AS {c}{k}" for c in ("kind", "name", "before", "own")]
    return f"SELECT {', '.join(cols)} FROM {source}"


_OWN = "src/n<n>/c<c>.ts"
_ORDERS = "(SELECT l.*, k.c_nationkey AS n, {call} AS call, CASE WHEN o % 2 = 0 THEN ';' ELSE '' END AS stop FROM links l JOIN customer k ON k.c_custkey = l.c) x".replace("{call}", _CALL)
_IMPORTED = f"(SELECT l.*, k.c_nationkey AS n, {_IMPORT} FROM (SELECT *, {_FORM} AS form FROM links WHERE pc <> c) l JOIN customer k ON k.c_custkey = l.c) x"
_PARTS = "(SELECT p_partkey AS k, s_suppkey AS s, s_nationkey AS n, {size} FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)) x".replace("{size}", "p_size AS size")
_SUPPLIERS = "(SELECT a.s_suppkey AS s, a.s_nationkey AS n, b.s_suppkey AS ps, b.s_nationkey AS pn, 1000 + b.s_suppkey AS pk, 1000 + a.s_suppkey AS k FROM supplier a JOIN supplier b ON b.s_suppkey = CAST(floor(a.s_suppkey / 3) AS BIGINT)) x"
_NATIONS = "(SELECT n_nationkey AS n, n_regionkey AS r FROM nation) x"
_BRANDS = "(SELECT substr(p_brand, 7) AS b, p_partkey AS k, p_size AS size FROM part) x"

PIECES_SQL = f"""{_LINKS},
pieces AS (
  {_piece("import", _OWN, "o", "", _IMPORTED)}
  UNION ALL {_piece("class", _OWN, "1000000000000", _CLASS, "(SELECT c_custkey AS c, c_nationkey AS n FROM customer) x")}
  UNION ALL {_piece("order", _OWN, "1000000000001 + 4 * o", _ORDER, _ORDERS)}
  UNION ALL {_piece("local", _OWN, "1000000000002 + 4 * o", _LOCAL, _ORDERS)}
  UNION ALL {_piece("limit", _OWN, "1000000000003 + 4 * o", _LIMIT, _ORDERS)}
  UNION ALL {_piece("shape", _OWN, "1000000000004 + 4 * o", _SHAPE, _ORDERS)}
  UNION ALL {_piece("risky", _OWN, "2000000000000 + o", _RISKY, "(SELECT * FROM " + _ORDERS + " WHERE priority = '1-URGENT') y")}
  UNION ALL {_piece("module", "app/n<n>/s<s>.py", "0", _MODULE, _SUPPLIERS)}
  UNION ALL {_piece("supplier", "app/n<n>/s<s>.py", "1", _SUPPLIER, _SUPPLIERS)}
  UNION ALL {_piece("nation", "go/n<n>.go", "0", _NATION, _NATIONS)}
  UNION ALL {_piece("brand", "styles/b<b>.css", "k", _BRAND, _BRANDS)})"""

#: The expected definitions of every file.
CHUNKS_OF_SOURCES_SQL = f"""{PIECES_SQL},
placed AS (SELECT *, sum(length(text)) OVER w - length(text) AS base, sum(length(text) - length(replace(text, chr(10), ''))) OVER w - (length(text) - length(replace(text, chr(10), ''))) + 1 AS line,
    sum(strlen(text)) OVER w - strlen(text) AS bytes
  FROM pieces WINDOW w AS (PARTITION BY path ORDER BY seq)),
defs AS ({" UNION ALL ".join(f"SELECT path, text, base, bytes, line, kind{k} AS kind, name{k} AS name, before{k} AS before, own{k} AS own FROM placed WHERE kind{k} IS NOT NULL" for k in range(4))}),
source_chunks AS (
  SELECT path, kind, name, CAST(base + length(before) AS BIGINT) AS start, CAST(base + length(before) + length(own) AS BIGINT) AS stop,
    CAST(line + length(before) - length(replace(before, chr(10), '')) AS BIGINT) AS first_line,
    CAST(line + length(before) - length(replace(before, chr(10), '')) + length(own) - length(replace(own, chr(10), '')) AS BIGINT) AS last_line,
    CAST(bytes + strlen(before) AS BIGINT) AS start_byte, CAST(bytes + strlen(before) + strlen(own) AS BIGINT) AS stop_byte, own AS code
  FROM defs)"""
SOURCES_SQL = f"""{PIECES_SQL}, sources AS (SELECT path, string_agg(text, '' ORDER BY seq) AS code, string_agg(blank, '' ORDER BY seq) AS blank FROM pieces GROUP BY 1)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every derived file, with the definitions in them."""
    return _run(spark, sf_dir, f"WITH {PIECES_SQL} SELECT * FROM pieces")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def _of_struct(sql: str, columns: str) -> str:
    """``sql`` with the columns read from a struct ``x``; literals stay."""
    parts = re.split(r"('[^']*')", sql)
    return "".join(p if k % 2 else re.sub(rf"\b({columns})\b", r"x.\1", p) for k, p in enumerate(parts))


_LINK = "o|p|pc|pn|priority|price"


def _of_link(seq: str, text: str, where: str = "") -> str:
    text = text.replace("CAST(call AS STRING)", f"({_CALL})").replace("CAST(stop AS STRING)", "CASE WHEN o % 2 = 0 THEN ';' ELSE '' END")
    links = f"filter(l, x -> {_of_struct(where, _LINK)})" if where else "l"
    return f"transform({links}, x -> struct({_of_struct(seq, _LINK)} AS seq, {_of_struct(text, _LINK)} AS text))"


_CODE = "array_join(transform(array_sort({}), x -> x.text), '') AS code"
#: A customer's file from its links (l), and a style sheet from its parts (l).
_OWN_FILE = _CODE.format(
    "concat("
    + ", ".join([
        _of_link("o", f"{_text(_HEAD)} || chr(39) || {_FORM} || chr(39) || {_text(';' + chr(10))}", "pc <> c"),
        f"array_repeat(struct(1000000000000 AS seq, {_text(_CLASS)} AS text), CAST(own AS INT))",
        *(_of_link(f"{1000000000001 + k} + 4 * o", _text(t)) for k, t in enumerate((_ORDER, _LOCAL, _LIMIT, _SHAPE))),
        _of_link("2000000000000 + o", _text(_RISKY), "priority = '1-URGENT'"),
    ])
    + ")"
)
_OTHER_PIECES = f"""{_piece("module", "app/n<n>/s<s>.py", "0", _MODULE, _SUPPLIERS)}
  UNION ALL {_piece("supplier", "app/n<n>/s<s>.py", "1", _SUPPLIER, _SUPPLIERS)}
  UNION ALL {_piece("nation", "go/n<n>.go", "0", _NATION, _NATIONS)}"""
_BRAND_FILE = _CODE.format(f"transform(l, x -> struct(x.k AS seq, {_of_struct(_text(_BRAND), 'k|size')} AS text))")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, code of every derived file.

    The keys of a file's pieces are gathered and its text is made of them afterwards, so no text is shuffled or
    spilled.  Files are dealt to as many tasks as the session shuffles to, since the texts are much larger than their keys.
    """
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = _run(spark, sf_dir, f"WITH {_LINKS} SELECT k.c_nationkey AS n, l.c, struct(o, p, pc, pn, priority, price) AS x, CAST(NULL AS INT) AS own FROM links l JOIN customer k ON k.c_custkey = l.c UNION ALL SELECT c_nationkey, c_custkey, NULL, 1 FROM customer")
    own = own.repartition(dealt, "n", "c").groupBy("n", "c").agg(F.collect_list("x").alias("l"), F.count("own").alias("own")).selectExpr(f"{_text(_OWN)} AS path", _OWN_FILE)
    # The largest files by far; dealt with a stated number of tasks, they are not put together in a few.
    brands = _run(spark, sf_dir, f"SELECT * FROM {_BRANDS}").repartition(dealt, "b").groupBy("b").agg(F.collect_list(F.struct("k", "size")).alias("l")).selectExpr(f"{_text('styles/b<b>.css')} AS path", _BRAND_FILE)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    others = _run(spark, sf_dir, _OTHER_PIECES).groupBy("path").agg(F.array_join(texts, "").alias("code"))
    return own.unionByName(brands).unionByName(others)
