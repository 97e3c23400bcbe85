"""The lexer and what is read from its tokens, against definitions written by hand and a second reader of pages."""

import os
from html.parser import HTMLParser

import pytest

from quarry.functions import lexer
from quarry.plans.definitions import define_chunks, name_places
from quarry.sources.tables import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCRIPT = """import { a as b } from './x';
/** class Fake { */
export class Foo<T extends {a: 1}> extends Bar {
  name() { return `#${'{' + "}"} ${ {b: `}`}.b } x`; }
  static async label(x?: string): Promise<{ a: string }> { return x; }
  plain = 1;
  get v(): number { return 1 }
  *gen() { yield 1; }
  #priv() { if (a) { foo(b) } }
  fn = (z) => { class Inner { m() {} } }
}
abstract class Abs { abstract foo(): void; bar() {} }
export async function order1(total: number, at = "{") { // }
  const inner = () => { return /[}/]+/.test(s) };
  let count = 1
  return s; /* } */
}
function over(a: string): void;
function over(a: any) { }
function* gg() {}
export interface Shape<T> extends X<{a: 1}> { b: T }
type Alias<T> = { a: string } | number;
export type U = 'a'
  | 'b'
const local = (x: number) => x + order1(x)
const local2 = async function (x) { return x };
export const LIMIT: number = 5, M = 2;
let z = { meth(q) { return q }, arrow: (a) => a, shape: { deep() {} } };
var old = () => 1;
export default function main() { for (const q of []) { const inn = q => q; } }
const { d1, d2 } = foo;
const C = class Named { go() {} };
"""


def texts(code, ext):
    return [(kind, name, code[a:b]) for kind, name, a, b in lexer.chunks(code, ext)]


def test_script_definitions():
    got = {name: (kind, text) for kind, name, text in texts(SCRIPT, ".ts")}
    assert list(got) == ["Foo", "name", "label", "v", "gen", "#priv", "Inner", "m", "bar", "order1", "inner", "over", "Shape", "Alias", "U", "local", "local2", "LIMIT", "z", "meth", "deep", "main", "inn", "C", "go"]
    assert got["Foo"][1].startswith("export class Foo") and got["Foo"][1].endswith("m() {} } }\n}")
    assert got["name"] == ("method", "name() { return `#${'{' + \"}\"} ${ {b: `}`}.b } x`; }")
    assert got["label"] == ("method", "static async label(x?: string): Promise<{ a: string }> { return x; }")
    assert got["order1"][1].endswith("/* } */\n}") and got["inner"] == ("func", "const inner = () => { return /[}/]+/.test(s) };")
    assert got["over"] == ("func", "function over(a: any) { }") and got["U"] == ("type", "type U = 'a'\n  | 'b'")
    assert got["local"] == ("func", "const local = (x: number) => x + order1(x)") and got["LIMIT"] == ("var", "export const LIMIT: number = 5, M = 2;")
    assert "interface" not in {k for k, _, _ in texts(SCRIPT, ".js")}


def test_python_and_go_definitions():
    code = '@dec\nclass Box(Base):\n    """A\ndef no():\n    """\n    x = {\n  1: 1}\n    def inner(self, a=(1,\n2)): return "#1"  # one\n\n    # c\n    async def go(self):\n        pass\ny = 1\ndef last(): return f"{y}"\n'
    assert [(k, n) for k, n, _ in texts(code, ".py")] == [("class", "Box"), ("func", "inner"), ("func", "go"), ("func", "last")]
    assert texts(code, ".py")[1][2] == 'def inner(self, a=(1,\n2)): return "#1"' and texts(code, ".py")[0][2].endswith("pass")
    code = "package main\n// func no() {\nfunc Run(a int, f func(int) string) (string, error) { return `}` + \"}\", nil }\nfunc (r *Recv) Do(x interface{}) struct{a int} {\n  type T struct { a int }\n}\ntype small struct {\n  a int\n}\ntype ( A int\n B string )\ntype Fn func(a int) string\nfunc ext(a int) int\n"
    assert [(k, n) for k, n, _ in texts(code, ".go")] == [("func", "Run"), ("method", "Do"), ("type", "small"), ("type", "A"), ("type", "Fn")]
    assert texts(code, ".go")[4][2] == "type Fn func(a int) string"


def test_styles_data_and_pages():
    css = '@import url("a.css"); /* .no { } */\n.a, #b > c { content: "}"; }\n@media (max-width: 3px) { .in { x: y } }\n@media screen and (x: 1) { .in2 { x: y } }\n@keyframes spin { from { a: b } }\n@font-face { a: b }'
    assert [n for _, n, _ in texts(css, ".css")] == ['"a.css"', "a b > c", "(max-width: 3px)", "in", "in2", "spin", "@font-face"]
    data = '{"a": {"b": [1, {"c": 2}]}, "d" : "x,}", "e": 12 , "f":[1,2],"g":null}'
    assert [t for _, _, t in texts(data, ".json")] == ['"a": {"b": [1, {"c": 2}]}', '"d" : "x,}"', '"e": 12', '"f":[1,2]', '"g":null']
    assert texts("[1]", ".json") == [] and texts("", ".json") == []
    page = '<div id="a" class=\'b c\'><p class=x>t<br><img id=i src="a>b"></p><script id="s">"</p><p class=no>"</script></div><ul class="u"><li id="l1">a</ul>'
    assert [n for _, n, _ in texts(page, ".html")] == ["a", "b c", "x", "i", "u", "l1"] and texts(page, ".html")[2][2] == '<p class=x>t<br><img id=i src="a>b"></p>'


@pytest.mark.parametrize("code", ["", "`", "`${", "`${`${", "}", ")]}", "'", '"""', "/*", "class", "class A", "const", "const x =", "function f(", "type A<", "export", "{" * 3000, "`${" * 800, "a\\", " é\x00"])
def test_broken_sources_end(code):
    for ext in (".ts", ".py", ".go", ".css", ".json", ".html", ".txt"):
        for _, _, a, b in lexer.chunks(code, ext):
            assert 0 <= a < b <= len(code)
        assert len(lexer.blank(code, ext)) == len(code)


def test_long_sources_take_time_in_proportion():
    import time

    def took(n):
        code = "class A {\n" + "  m() { return `${ f({ a: 1 }) } x`; }\n" * n + "}\n"
        begin = time.process_time()
        assert len(lexer.chunks(code, ".ts")) == n + 1
        return time.process_time() - begin

    took(100)
    assert took(8000) < 40 * max(took(1000), 0.01)


def test_blank_keeps_places_and_substituted_code():
    code = "a `x${b + `q${c}`}y` 'z'; /*c\nd*/ /re'g/ e // f"
    got = lexer.blank(code)
    assert len(got) == len(code) and [w for w in got.split() if w.isalpha()] == ["a", "b", "c", "e"] and got.count("\n") == 1
    assert all(x == y for x, y in zip(got, code, strict=True) if x != " ")


def test_occurrences():
    got = lexer.occurrences("const x = 'x'; // x\nfoo.x = { x: 1, x }; `${x} ${x+1} x`; f(x, y)", {"x", "y"})
    assert [(n, line, how) for n, line, _, how in got] == [("x", 1, "high"), ("x", 1, "review"), ("x", 1, "review"), ("x", 2, "review"), ("x", 2, "review"), ("x", 2, "review"), ("x", 2, "review"), ("x", 2, "high"), ("x", 2, "review"), ("x", 2, "high"), ("y", 2, "high")]
    assert got[0][2] == 7


class Elements(HTMLParser):
    """Names and begins of elements, by another reader."""

    def __init__(self, text):
        super().__init__(convert_charrefs=False)
        self.found, self.lines = [], [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        if tag not in ("script", "style"):
            line, column = self.getpos()
            self.found += [(v, self.lines[line - 1] + column) for k, v in attrs if k in ("id", "class") and v]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no data")
def test_elements_of_all_pages_equal_another_reader(spark):
    from quarry.catalog import QUERIES

    got = sorted((r.page_id, r.name, r.start) for r in QUERIES["c1_page_elements"](spark, SF_DIR).collect())
    want = sorted((r.page_id, " ".join([name.strip()]), at) for r in table(spark, SF_DIR, "pages").collect() for name, at in Elements(r.html).found)
    assert got == want and len(got) >= 50


def test_chunks_of_odd_files(spark):
    rows = [("a.ts", None), ("b.ts", ""), (None, "class A {}"), ("c.unknown", "class A {}"), ("d.ts", "é\nclass É {}\n" + "const x = 1;\n" * 3000), ("d.ts", "class É {}"), ("dir.ts/noext", "class A {}"), ("E.TS", "class E {}")]
    files = spark.createDataFrame(rows, "path string, code string")
    got = define_chunks(files).collect()
    assert sorted({(r.path, r.name) for r in got}) == [("E.TS", "E"), ("d.ts", "x"), ("d.ts", "É")]
    first = next(r for r in got if r.path == "d.ts" and r.start == 2)
    assert (first.start_byte, first.stop_byte, first.first_line, first.code) == (3, 14, 2, "class É {}")
    assert define_chunks(files, most=5).where("path = 'd.ts'").count() == 6
    assert define_chunks(files.limit(0)).count() == 0
    places = name_places(files, spark.createDataFrame([("A",), ("x",), (None,), ("A",)], "name string"))
    assert places.where("name = 'x'").count() == 3000 and places.where("path = 'c.unknown'").count() == 1


def old_style(code, ext):
    """Blanked, and texts of the tokens that are no comments, from the tokens of the whole source."""
    ts = lexer.tokens(code, ext)
    out = list(code)
    for t in ts:
        if t.kind in (lexer.STRING, lexer.COMMENT):
            out[t.start : t.end] = [c if c == "\n" else " " for c in code[t.start : t.end]]
    return "".join(out), [(t.text, t.start, t.depth) for t in ts if t.kind != lexer.COMMENT]


def test_scripts_read_in_two_steps_have_the_same_tokens():
    import random

    rng = random.Random(5)
    some = ["class A", "(", ")", "[", "]", "{", "}", "<", "=>", "=", ";", "'", '"', "`", "${", "`x${", "}y`", "\\", "/", "//", "/*", "*/", "/a[/]b/g", "\n", " ", "3.5", "é", "𝒳", "😀", " ", "return", "#p", "#", "f", ".", "if"]
    for _ in range(3000):
        code = "".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40)))
        blank, wanted = old_style(code, ".ts")
        s = lexer._Script(code, ".ts")
        assert list(zip(s.texts[: s.n], s.start, s.depth, strict=True)) == wanted, code
        assert lexer.blank(code, ".ts") == blank, code
        assert lexer.blank(code, ".css") == old_style(code, ".css")[0], code


def test_style_sheets_are_read_in_parts(monkeypatch):
    rule = '.b1, #p2 > a { width: 3px; content: "}"; } /* .no { } */\n@media (max-width: 3px) { .in { color: red; } }\n@keyframes s { from { a: b } }\né {}\n'
    for code in (rule * 20, rule * 3 + "} .a { (b { c } .d { } " + rule * 3, rule * 3 + ".a { '" + rule, ""):
        whole = [(k, n, a, b) for k, n, a, b in lexer.chunks(code, ".css")]
        monkeypatch.setattr(lexer, "PART", 50)
        parts = list(lexer.parts(code, ".css"))
        monkeypatch.undo()
        assert "".join(parts) == code and max(map(len, parts[:-1]), default=0) < 50 + 2 * len(rule)
        begins = [sum(map(len, parts[:k])) for k in range(len(parts))]
        assert [(k, n, a + at, b + at) for at, part in zip(begins, parts, strict=True) for k, n, a, b in lexer.chunks(part, ".css")] == whole
    assert len(list(lexer.parts(rule * 2000, ".css"))) > 4


def test_definitions_of_long_sheets_and_places_in_them(spark):
    code = "é {}\n" + '.b { content: "}";\n}\n' * 20_000
    got = define_chunks(spark.createDataFrame([("a.css", code), ("b.css", "x {}")], "path string, code string")).where("path = 'a.css'").orderBy("start").collect()
    assert len(got) == 20_001
    for r in (got[1], got[9_000], got[-1]):
        assert r.code == code[r.start : r.stop] and code[: r.start].count("\n") + 1 == r.first_line and r.last_line == r.first_line + 1
        assert r.start_byte == len(code[: r.start].encode()) and r.stop_byte == len(code[: r.stop].encode())
    assert define_chunks(spark.createDataFrame([("a.css", code)], "path string, code string"), most=7_000).count() == 7_000


def test_long_sheets_are_blanked_in_parts(spark, monkeypatch):
    from quarry.plans.definitions import blanked

    code = "é {}\n" + '.b { content: "}\\"";\n} /* { "\n */\n' * 10_000
    assert len(list(lexer.parts(code, ".css"))) > 3
    got = {r.path: r.blank for r in blanked(spark.createDataFrame([("a.css", code), ("b.ts", "`x${a}`"), ("c.css", None), (None, "x")], "path string, code string")).collect()}
    assert got == {"a.css": lexer.blank(code, ".css"), "b.ts": "    a  ", "c.css": ""}


def plan_of(spark, name):
    from quarry.catalog import QUERIES

    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_an_outline_gets_no_texts(spark):
    plan = plan_of(spark, "c4_source_outline")
    made = next(line for line in plan.split("\n") if "MapInArrow" in line)
    assert "marked" in made and "code#" not in made.split("[", 1)[1]


def test_shorthands_are_made_where_the_texts_are(spark):
    plan = plan_of(spark, "t26_source_shorthands")
    assert "ArrowEvalPython" not in plan and plan.index("MapInArrow") < plan.index("Filter")


def test_names_are_found_where_the_texts_are(spark):
    plan = plan_of(spark, "t21_declared_names")
    assert "ArrowEvalPython" not in plan and plan.index("MapInArrow") < plan.index("Filter")
