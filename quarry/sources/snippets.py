"""Short sources with what the functions on source text must give for them, dealt to the events.

Each event has the source of its number, with ``{u}`` replaced by its user; the SQL of a query gives the
expected value, which was written by hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table


@dataclass(frozen=True)
class Snippet:
    path: str
    code: str
    name: str = ""
    risk: str = "LOW"
    defects: str = ""
    imports: str = ""
    exports: str = ""
    dependencies: str = ""
    light: str = ""
    references: str = ""
    blank: str = ""
    exported: str = "false"
    outline: str = ""
    occurrences: str = ""
    shorthand: str = ""
    is_error: str = "false"


CODE = [
    Snippet(
        "a/plain.ts",
        "import x from './m{u}';\nexport function calc{u}(a) { if (a) { a += 1 } }",
        name="calc{u}", imports="./m{u}", exports="calc{u}", exported="true", outline="2:calc{u}", occurrences="1:high", shorthand="[ts] import x from './m{u}';\nexport function calc{u}(a) { if (a) { a += 1 } }", references="calc{u},./m{u}",
        light="import x from './m{u}';\nexport function calc{u}(a) { if (a) { a += 1 } }",
    ),
    Snippet(
        "a/price.ts",
        "export async function calculatePrice{u}(a: any) {\n  if (a) { a += 1; }\n  for (const b of a) { b.push(a * 2); }\n  return a.price * a.volume;\n}",
        name="calculatePrice{u}", risk="HIGH", defects="type-escape-any", exports="calculatePrice{u}", exported="true", outline="1:calculatePrice{u}", occurrences="", shorthand="[ts] export async function calculatePrice{u}(a: any) { /* L1-L5 */ }", references="calculatePrice{u},b.push",
        light="export async function calculatePrice{u}(a: any) {\n  if (a) { a += 1; }\n  for (const b of a) { b.push(a * 2); }\n  return a.price * a.volume;\n}",
    ),
    Snippet(
        "a/check.js",
        "function validate{u}(x) {\n  x.add(1); // once\n  x.add(2);\n  x.add(3);\n}",
        name="validate{u}", risk="MED", outline="1:validate{u}", occurrences="1:high,2:high,3:high,4:high", shorthand="[js] function validate{u}(x) { /* L1-L5 */ }", references="validate{u},x.add",
        light="function validate{u}(x) {\n  x.add(1);\n  x.add(2);\n  x.add(3);\n}",
    ),
    Snippet(
        "a/bad.ts",
        "try { go(); } catch (e) {}\n// @ts-ignore\nconst v = w!.x;\nfunction f{u}() { return v as any; }",
        name="f{u}", defects="swallowed-error,ts-suppress,type-escape-any,non-null-assert", outline="4:f{u}", occurrences="3:review", shorthand="[ts] try { /* L1-L4 */ }", references="go,f{u}",
        light="try { go(); } catch (e) {}\n\nconst v = w!.x;\nfunction f{u}() { return v as any; }",
    ),
    Snippet(
        "a/loads.ts",
        "import { Alpha as A1, type Beta } from './lib/util{u}.js';\nimport fs from 'fs';\nconst { gamma: g } = require('./g{u}');\nimport './side{u}';\nconst d = await import('./dyn{u}');\nexport const Total{u} = A1;",
        imports="./dyn{u},./g{u},./lib/util{u}.js,./side{u},fs", exports="Total{u}", dependencies="Alpha>A1>util{u},Beta>Beta>util{u},gamma>g>g{u}", outline="", occurrences="", references="require,import,./lib/util{u}.js,fs",
        light="import { Alpha as A1, type Beta } from './lib/util{u}.js';\nimport fs from 'fs';\nconst { gamma: g } = require('./g{u}');\nimport './side{u}';\nconst d = await import('./dyn{u}');\nexport const Total{u} = A1;",
    ),
    Snippet(
        "b/box.py",
        "import os\nfrom .core{u} import Widget as W, helper\nclass Box{u}:\n    \"\"\"A box.\"\"\"\n    def inner(self): return '#1'  # one\nasync def go{u}(): pass\nprint('x', (1))\n",
        name="inner", imports=".core{u},os", exports="Box{u},go{u}", dependencies="Widget>W>core{u},helper>helper>core{u}", exported="true", outline="3:Box{u},5:inner,6:go{u}", occurrences="7:review", references="inner,go{u},print",
        light="import os\nfrom .core{u} import Widget as W, helper\nclass Box{u}:\n    \"\"\n    def inner(self): return '#1'\nasync def go{u}(): pass\n",
    ),
    Snippet(
        "c/run.go",
        "package main\nimport (\n\t\"fmt\"\n\tlocal \"./local{u}\"\n)\nfunc Run{u}(a int) string { return fmt.Sprint(a) }\ntype small{u} struct {}\nvar Big{u} = 1",
        name="Run{u}", imports="./local{u},fmt", exports="Big{u},Run{u}", exported="true", outline="6:Run{u}", occurrences="", references="import,Run{u},fmt.Sprint",
        light="package main\nimport (\n\t\"fmt\"\n\tlocal \"./local{u}\"\n)\nfunc Run{u}(a int) string { return fmt.Sprint(a) }\ntype small{u} struct {}\nvar Big{u} = 1",
    ),
    Snippet(
        "a/noise.js",
        "/* head\n */\nlet a{u} = 'b';\nconsole.log('x)', (1 + (2)));\n\n\n\n// tail\ndebugger;\nlet b = 2;",
        outline="", occurrences="4:review", references="console.log",
        light="let a{u} = 'b';\n\nlet b = 2;",
    ),
]

#: Strings and comments; ``blank`` is the source with them blanked.
LITERALS = [
    Snippet("a/s.ts", "say(\"hi\"); // note\nlet a = 'b';", blank="say(    );        \nlet a =    ;"),
    Snippet("a/t.ts", "/* one\n two */ f(`x\ny`, 'it\\'s')", blank="      \n        f(  \n  ,        )"),
    Snippet("a/u.ts", "a = b / c; // d\n\"//\" + e", blank="a = b / c;     \n     + e"),
    Snippet("a/v.ts", "no literal here", blank="no literal here"),
]

#: Outputs of tools, and whether they tell an error.
OUTPUTS = [
    Snippet("o", "error TS2304: cannot find {u}", is_error="true"),
    Snippet("o", "npm ERR! code {u}", is_error="true"),
    Snippet("o", "ok\n  FAIL lib/t{u}.js", is_error="true"),
    Snippet("o", "Process exited with code 1", is_error="true"),
    Snippet("o", "Process exited with code 0 after {u} tests"),
    Snippet("o", "2 tests failed, {u} passed", is_error="true"),
    Snippet("o", "catches a TypeError: in docs, {u}"),
    Snippet("o", "RangeError: {u}\nat a.ts"),
    Snippet("o", "TypeError: x{u}\nat a.ts", is_error="true"),
    Snippet("o", "ENOENT: no file {u}, Cannot find module", is_error="true"),
    Snippet("o", "ENOENT may be ignored {u}"),
    Snippet("o", ""),
]


def snippets(spark: SparkSession, sf_dir: str, of: list[Snippet]) -> DataFrame:
    """id, path, code of every event."""
    at = (F.col("event_id") % len(of) + 1).cast("int")
    pick = lambda field: F.element_at(F.array(*(F.lit(getattr(s, field)) for s in of)), at)
    code = F.replace(pick("code"), F.lit("{u}"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), pick("path").alias("path"), code.alias("code"))


def expected_sql(of: list[Snippet], *fields: str) -> str:
    """The expected values of every event."""

    def column(field: str) -> str:
        quoted = (getattr(s, field).replace("'", "''") for s in of)
        cases = " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(quoted))
        return f"replace(CASE event_id % {len(of)} {cases} END, '{{u}}', CAST(user_id AS VARCHAR)) AS \"{field}\""

    return f"SELECT event_id AS id, {', '.join(map(column, fields))} FROM events"
