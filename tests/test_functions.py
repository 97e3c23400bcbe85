"""Closed forms and literals."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.catalog import QUERIES
from quarry.functions import code, text
from quarry.operators import aggregates, logs, relations, retrieval, windows
from quarry.plans import graph
from quarry.plans.spectral import spectrum
from quarry.sources.files import admission
from quarry.streaming.breaker import Breaker, Call, Ledger, Rules, trend
from quarry.streaming.events import token_bucket


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "parts"),
    [("authMiddleware", "auth middleware"), ("auth_middleware", "auth middleware"), ("MAX_RETRY_COUNT", "max retry count"), ("req.body.user", "req body user"), ("getAPIResponse", "get api response"), ("HTMLParser", "html parser"), ("$scope", "scope"), ("__proto__", "proto"), ("_privateVar", "private var"), ("XMLHttpRequest", "xml http request"), ("", ""), ("authentication", "authentication"), ("isXValue", "is xv alue"), ("a1b2", "a 1 b 2"), ("auth.auth", "auth")],
)
def test_identifier_parts(spark, name, parts):
    assert " ".join(one(spark, text.split_identifier(F.lit(name)))) == parts


def test_phrase_boost_and_scores(spark):
    rows = spark.createDataFrame([(1, "/a", "[func] authMiddleware() auth middleware handler"), (2, "/b", "[func] something() auth unrelated middleware")], "id long, path string, raw string")
    got = {r.id: r.score for r in retrieval.bm25(retrieval.build_index(rows), ["auth", "middleware"], 5).collect()}
    assert got[1] == pytest.approx(0.829390, abs=1e-6) and got[2] == pytest.approx(0.372257, abs=1e-6)


def test_grep_lines(spark):
    rows = spark.createDataFrame([(1, "export function funcA() {\n  const x = 1;\n}"), (2, "a\nexport export export;"), (3, "none")], "id long, raw string")
    assert [(r.id, r.line_no) for r in retrieval.grep(rows, "export", 50).collect()] == [(1, 1), (2, 2)]


def edges(n, kind):
    pairs = {"clique": [(i, j) for i in range(n) for j in range(i)], "ring": [(i, (i + 1) % n) for i in range(n)], "star": [(0, i) for i in range(1, n)], "two": [(0, 1), (2, 3)]}[kind]
    u, v = np.array(pairs).T
    return u, v, np.ones(len(u))


@pytest.mark.parametrize(("n", "kind", "normalized", "want"), [(5, "clique", False, 5.0), (10, "ring", False, 2 - 2 * math.cos(2 * math.pi / 10)), (5, "star", True, 1.0), (5, "clique", True, 1.25), (4, "two", False, 0.0), (3, "clique", False, 3.0), (1600, "star", False, 1.0)])
def test_second_eigenvalue(n, kind, normalized, want):
    assert spectrum(n, *edges(n, kind), normalized).lambda2 == pytest.approx(want, abs=1e-6)


def test_no_spectrum_of_large_graphs_but_a_volume():
    s = spectrum(26_000, np.array([0]), np.array([1]), np.array([1.5]))
    assert s.lambda2 is None and s.volume == 1.5


def test_pagerank_and_tiers(spark):
    pairs = [("a", "core"), ("b", "core"), ("l1", "a"), ("l2", "b"), ("l1", "util"), ("l2", "util"), ("l3", "util")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    v = spark.createDataFrame([(x,) for x in ("core", "util", "a", "b", "l1", "l2", "l3")], "node string")
    ranks = graph.cut(graph.pagerank(v, e))
    pr = {r.node: r.pr for r in ranks.collect()}
    assert pr["core"] == 1.0
    assert [round(pr[k], 6) for k in ("util", "a", "b", "l1")] == [0.788897, 0.416362, 0.416362, 0.292184]
    degree = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    tier = {r.node: r.tier for r in graph.tiers(ranks, degree).collect()}
    assert tier == {"core": "core", "util": "core", "a": "logic", "b": "logic", "l1": "leaf", "l2": "leaf", "l3": "leaf"}
    assert aggregates.normalized_entropy(ranks, "pr").first()["entropy"] == pytest.approx(0.936626, abs=1e-6)


def test_spectral_entropy(spark):
    assert one(spark, aggregates.von_neumann(F.array(*map(F.lit, [0.0, 0.059581, 0.161211, 0.228693, 0.360901])))) == pytest.approx(1.2304031755, abs=1e-7)


def test_log_collapse():
    assert logs.collapse(["x"] * 50) == ["x", "  [repeated 49 more times]"]
    assert logs.collapse(["A", "B", "B", "C"]) == ["A", "B", "B", "C"]
    assert logs.collapse(["a", "b", "c"] * 5 + ["d"]) == ["a", "b", "c", "  [block repeated 5 times, showing once]", "d"]


def test_condense(spark):
    frames = [f"  at x (node_modules/a/b.js:{k}:2)" for k in range(100)]
    rows = [(1, "\n".join(frames + ["real"])), (2, "\n".join(f"u{k}" for k in range(500))), (3, "err at 0xAB\nerr at 0xCD"), (4, "src/a.ts:1:2\nsrc/a.ts:3:4"), (5, None)]
    got = {r.id: r for r in logs.condense(spark.createDataFrame(rows, "id long, t string"), "id", "t", 50).collect()}
    assert got[1].n_lines <= 3 and got[1].reduction >= 80 and got[2].n_lines == 51 and "truncated" in got[2].lines[-1]
    assert got[3].n_lines == 1 and got[4].n_lines == 2 and got[5].lines == [""]


def test_error_fingerprints_ignore_places(spark):
    a, b, c = ("TypeError: x at f.ts:1:2 line 4", "TypeError: x at f.ts:9:8 line 7", "TypeError: y at f.ts:1:2")
    f = [one(spark, text.error_fingerprint(F.lit(x))) for x in (a, b, c)]
    assert f[0] == f[1] != f[2] and len(f[0]) == 16


def test_admission(spark):
    ok = lambda p, n: one(spark, admission(F.lit(p), F.lit(n))) is None
    assert ok("a.ts", 5000) and ok("a.ts", 500_000) and not ok("a.ts", 500_001)
    assert not any(ok(f"x{s}", 1) for s in (".min.js", ".map", ".wasm", ".png", ".exe", ".lock"))


def run_calls(calls, state=None, rules=None):
    state = state or Breaker()
    return [state.call(Call(1000 * k, *c), rules or Rules()) for k, c in enumerate(calls)], state


def test_breaker_patterns():
    same, state = run_calls([("read", "e1", None)] * 3)
    assert [x[0] for x in same] == ["", "", "same error"] and state.level == 1 and state.saved == 10_000
    assert not any(x[0] for x in run_calls([("read", f"e{k}", None) for k in range(3)])[0])
    assert run_calls([("edit", None, "a")] * 5)[0][-1][0] == "same file"
    assert not any(x[0] for x in run_calls([("edit", None, f"f{k}") for k in range(5)])[0])
    assert not any(x[0] for x in run_calls([("read", None, "a")] * 9)[0])
    cycle = [c for k in range(3) for c in (("edit", None, f"f{k}"), ("bash", None, None), ("bash", f"e{k}", None))]
    assert [x[0] for x in run_calls(cycle)[0]][-1] == "cycle"
    assert not any(x[0] for x in run_calls([("edit", None, "f"), ("bash", None, None)] * 2)[0])
    assert run_calls([(t, f"e{k}", "a") for k, t in enumerate(("read", "edit", "bash"))])[0][-1][0] == "file failures"


def test_breaker_resets_and_levels():
    trip = [("read", "e1", "a")] * 3
    got, state = run_calls([*trip, ("read", None, "a"), *trip, ("read", None, "a"), *trip, ("read", None, "a"), ("read", None, "a")])
    assert [x[1] for x in got] == [0, 0, 1, 1, 0, 0, 2, 2, 0, 0, 3, 3, 3]  # a blocked call resets softly, but not at the last level
    assert [x[2] for x in got].count(True) == 4 and state.redirects == 2 and state.loops == 3
    assert state.call(Call(13_000, "other", None, "b"), Rules())[0] == ""  # another tool: softly, the level stays
    assert state.level == 3 and state.redirects_worked == 1
    again, state = run_calls(trip)
    assert state.call(Call(2000 + 60_000, "read", None, "a"), Rules())[2]  # not longer than the limit
    again, state = run_calls(trip)
    assert state.call(Call(2000 + 60_001, "read", None, "a"), Rules())[0] == "" and state.level == 0
    old = Breaker()
    assert [old.call(Call(t, "read", "e1"), Rules())[0] for t in (0, 1, 300_002)] == ["", "", ""]  # calls are forgotten after five minutes
    assert [Breaker().call(Call(t, "read", "e1"), Rules())[0] for t in (0, 1, 300_000)] == ["", "", ""]
    gone = Breaker()
    for t, f in ((0, "a"), (1, "a"), (300_002, "b")):
        gone.call(Call(t, "read", f"e{t}", f), Rules())
    assert gone.failures == {"b": 1}  # and with them the failures of their files
    assert Breaker.load(state.dump()) == state
    long = Breaker()
    for k in range(80):
        long.call(Call(k, "read", None, None), Rules())
    assert len(long.history) == 50 and long.calls == 80


def test_ledger():
    book, seen = Ledger(), []
    for kind in ("trip", "error", "heal", "success"):
        book.step(kind, 1)
        seen.append(book.score)
    book.decay(3)
    seen.append(book.score)
    book.step("regressions", 3, ["a", "b", "c"])
    assert seen == pytest.approx([10, 13, 14, 7, 5.0575]) and book.score == pytest.approx(16.269078) and book.alert
    book.step("restored", 3, ["a"])
    assert sorted(book.debts) == ["b", "c"]
    book.decay(60)
    assert book.score == 0 and book.debts  # debts are never forgotten
    two = Ledger(20.0, 1)
    two.decay(6)
    assert two.score == pytest.approx(20 * 0.85**5)
    many = Ledger()
    many.step("regressions", 1, [f"s{k}" for k in range(20)])
    assert 105 < many.score < 115
    for k in range(60):
        many.step("regressions", 2 + k, [f"t{k}"])
    assert len(many.debts) == 50 and "s0" not in many.debts
    assert [trend(3, n) for n in (1, 3, 9)] == ["improving", "stable", "degrading"]


def test_token_bucket():
    got, tokens, last = token_bucket([(0.0, k) for k in range(12)] + [(1.0, 99)], 10.0, None)
    assert [x for _, x in got] == [True] * 10 + [False] * 2 + [True]


def test_fragility_order_matters(spark):
    rows = [("f", 1, "signup"), ("f", 2, "error"), ("f", 3, "view"), ("f", 4, "purchase"), ("g", 1, "purchase"), ("g", 2, "signup")]
    got = {r.k: r.score for r in windows.fragility(spark.createDataFrame(rows, "k string, seq int, kind string"), "k", "seq", "kind").collect()}
    assert got == {"f": 7.0, "g": 10.0}


def test_greedy_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("k", 1, 50), ("k", 2, 60), ("k", 3, 30)], "k string, id long, n long")
    r = windows.greedy_budget(rows, "k", "n", 95).first()
    assert (r.used, r.ids) == (90, "2,3")


def test_usage_totals(spark):
    log = spark.range(100).selectExpr("timestamp_ntz'2024-01-01' as ts", "10L as input_tokens", "20L as output_tokens", "50L as saved_tokens")
    assert tuple(aggregates.usage_totals(log).first()) == (100, 1000, 2000, 5000)
    assert tuple(aggregates.usage_totals(log.limit(0)).first()) == (0, 0, 0, 0)


def test_multiset_difference_keeps_later_rows(spark):
    f = lambda rows: spark.createDataFrame(rows, "k string, i int")
    got = relations.new_findings(f([("a", 1), ("a", 2), ("a", 3), ("b", 4)]), f([("a", 0), ("c", 1)]), "k", "i").collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 2), ("a", 3), ("b", 4)]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("agreed", "agre"), ("controll", "control"), ("generalizations", "gener"), ("adoption", "adopt"), ("is", "is"), ("sky", "sky")])
def test_stems(word, stem):
    assert code.stem(word) == stem


def test_imports_exports_and_defects(spark):
    src = "import a from './a';\nconst b = require(\"b\");\nexport class K {}\nexport default async function go() {}\ntry { x() } catch (e) {}\n"
    assert one(spark, code.extract_imports(F.lit(src), F.lit(".ts"))) == ["./a", "b"]
    assert one(spark, code.extract_exports(F.lit(src), F.lit(".ts"))) == ["K", "go"]
    assert one(spark, code.defects(F.lit(src))) == ["swallowed-error"]
    assert one(spark, code.normalize_web_symbol(F.lit(".foo, #bar"), F.lit(".css"))) == "foo bar"


def test_structure_functions():
    from quarry.functions import structure as s

    assert s.remove_calls("a; console.log('x)', f(1)); b") == "a;  b"
    assert s.remove_calls("print(1") == "print(1"
    assert s.lexer.blank("x = 'a\\'b' // c\ny") == "x =              \ny".replace("             ", " " * 11)
    assert s.signature("export function f(a: Map<string, number>, b = '{') : X {\n return 1 }") == "export function f(a: Map<string, number>, b = '{') : X"
    assert s.signature("def g(a: int = 3) -> int:\n    pass") == "def g(a: int = 3) -> int"
    assert s.signature("const h = (x) => { y }") == "const h = (x) =>"
    assert s.clean_signature("export default async function f()") == "function f()"
    assert s.dependencies('import { foo, bar as baz } from "./utils/math";\nimport {q} from "ext"', ".ts") == [("foo", "foo", "math"), ("bar", "baz", "math")]
    assert s.dependencies('const { foo: f2 } = require("./m.js")', ".js") == [("foo", "f2", "m")]
    assert s.dependencies("from pkg.mod import alpha, beta as b", ".py") == [("alpha", "alpha", "mod"), ("beta", "b", "mod")]
    assert s.shorthand("func", "a\nb", 1, 2) == "[func] a\nb" and s.shorthand("func", "f() {\n a\n b\n}", 3, 6) == "[func] f() { /* L3-L6 */ }"
    assert s.regressed("f(a: X): Y", "f(a: any): Y") and not s.regressed("f(a: any)", "f(a: any)")


def pruned(texts, share, alpha):
    """Words, and kept words by the rules of the operator: common words by their share of the corpus, all protections."""
    every = [w.lower() for t in texts.values() for w in t.split()]
    share_of = {w: n / len(every) for w, n in collections.Counter(every).items()}
    out = {}
    for k, t in texts.items():
        words, own = t.split(), collections.Counter(w.lower() for w in t.split())
        kinds, safe, before = len(own), [], ""
        scores = []
        for w in words:
            p = share_of[w.lower()] if share_of[w.lower()] >= 0.001 else 0.0001
            scores.append(round(alpha * -math.log2(p) + (1 - alpha) * own[w.lower()] / max(own.values()) * math.log2(1 + kinds / own[w.lower()]), 9))
            plain = re.fullmatch(r"[{}()\[\];:,=<>!&|+\-*/%^~?@#]|=>|\.\.\.|\d+(\.\d+)?", w)
            safe.append(bool(plain) or w[0].isupper() or any(c in w for c in ".()") or w.lower() in code_words or before in code_words)
            before = w.lower()
        free = sorted(x for x, p in zip(scores, safe, strict=True) if not p)
        cut = free[int(len(free) * share)] if free else 0
        out[k] = (len(words), sum(p or x >= cut for x, p in zip(scores, safe, strict=True)))
    return out


code_words = "function class interface type import export return throw await const let var new extends implements from as enum def func struct package async yield".split()


@pytest.mark.parametrize(("name", "share", "alpha"), [("t9_medium_pruning", 0.3, 0.5), ("t11_aggressive_pruning", 0.5, 0.7)])
def test_pruning_covers_every_document(spark, tmp_path, name, share, alpha):
    rng = random.Random(13)
    words = ["the", "of", "Graph", "node", "a.b", "x1", "edge", "Of", "rare", "path", "end.", "return", "12", "f(x)", "=>", "new"]
    texts = {k: " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(1, 60))) for k in range(1, 26)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: (r.words, r.kept) for r in QUERIES[name](spark, str(tmp_path)).collect()} == pruned(texts, share, alpha)


def test_stored_index_follows_its_chunks(spark, tmp_path):
    from quarry.operators.stored_index import StoredIndex, boosted

    rows = [(k, f"/src/f{k}", f"alpha beta{k} gammaDelta word{k % 3}") for k in range(12)]
    frame = lambda r: spark.createDataFrame(r, "id long, path string, raw string")
    index = StoredIndex(spark, f"file://{tmp_path}/a")
    assert index.search(["alpha"], 5).count() == 0
    assert index.update(frame(rows)) == {"indexed": 12, "skipped": 0, "removed": 0}
    changed = [*rows[:5], (5, "/src/f5", "delta alpha alpha"), *rows[6:10], (20, "/src/new", "gamma delta"), (21, "/src/empty", None)]
    assert index.update(frame(changed)) == {"indexed": 3, "skipped": 9, "removed": 2}
    whole = StoredIndex(spark, f"file://{tmp_path}/b")
    whole.update(frame(changed))
    found = lambda i: [(r.id, r.score) for r in i.search(["gamma", "delta", "alpha"], 50).collect()]
    direct = [(r.id, r.score) for r in retrieval.bm25(retrieval.build_index(frame(changed).na.fill("")), ["gamma", "delta", "alpha"], 50).collect()]
    assert found(index) == found(whole) == direct == found(StoredIndex.open(spark, index.path)) == found(index.vacuum(f"file://{tmp_path}/c"))
    assert [r.id for r in boosted(index, ["delta"], 1).collect()] == [20]
    index.remove(spark.createDataFrame([(20,), (99,)], "id long"))
    assert index.docs().count() == 11 and 20 not in dict(found(index))
    assert StoredIndex.open(spark, index.path, version=2).docs().count() == 12 and StoredIndex.open(spark, index.path, version=1).search(["beta3"], 5).count() == 0
    index.wipe()
    assert StoredIndex.open(spark, index.path).docs().count() == 0


INDEXED = "id long, path string, raw string, vector array<float>"


def test_one_version_of_all_tables_of_an_index(spark, tmp_path):
    from quarry.operators.stored_index import StoredIndex

    rows = [(k, f"/src/f{k // 2}", f"alpha beta{k} own{k}", [float(k), 1.0] if k % 3 else []) for k in range(10)]
    frame = lambda r: spark.createDataFrame(r, INDEXED)
    index = StoredIndex(spark, f"file://{tmp_path}/a")
    index.update(frame(rows))
    assert index.dim == 2 and sorted(r.id for r in index.vectors().collect()) == [k for k in range(10) if k % 3]
    assert [r.id for r in index.nearest([1.0, 0.0], 2).collect()] == [8, 7] and {r.path for r in index.files_with("own3").collect()} == {"/src/f1"}
    index.remove_paths(spark.createDataFrame([("/src/f1",), ("/none",)], "path string"))
    whole = lambda i: tuple(sorted({r.id for r in t.collect()}) for t in (i.docs(), i.postings(), i.identifiers(), i.vectors()))
    left = [k for k in range(10) if k not in (2, 3)]
    assert whole(index) == (left, left, left, [k for k in left if k % 3]) and (index.n, index.dead) == (8, 2)
    assert index.files_with("own3").count() == 0 and [r.id for r in index.search(["own", "3"], 3).collect() if r.id == 3] == []
    packed = index.vacuum(f"file://{tmp_path}/b")
    assert whole(packed) == whole(index) and (packed.n, packed.total, packed.dead, packed.dim) == (8, index.total, 0, 2)
    index.update(frame([(1, "/src/f0", "alpha", [1.0, 2.0, 3.0])]))  # vectors of another length
    assert index.dim == 3 and whole(index) == ([1], [1], [1], [1]) and index.version == 1
    index.update(frame([]))
    assert whole(index) == ([], [], [], []) and index.n == 0 and index.search(["alpha"], 5).count() == 0


@pytest.mark.parametrize("failing", ["postings", "identifiers", "vectors", "docs", "dead", "version"])
def test_a_failed_update_leaves_the_last_version(spark, tmp_path, monkeypatch, failing):
    from quarry.operators.stored_index import StoredIndex

    frame = lambda r: spark.createDataFrame(r, INDEXED)
    first = [(1, "/a", "alpha beta", [1.0]), (2, "/b", "alpha", None)]
    second = [(2, "/b", "alpha alpha gamma", [2.0]), (3, "/c", "alpha", [3.0])]
    index = StoredIndex(spark, f"file://{tmp_path}/a")
    index.update(frame(first))
    state = lambda i: ([(r.id, r.score) for r in i.search(["alpha", "gamma"], 9).collect()], sorted(r.id for r in i.vectors().collect()), i.n, i.total)
    before = state(index)
    write = StoredIndex._write

    def broken(self, name, rows):
        if name.split("/")[0] == failing:
            raise OSError("no space")
        write(self, name, rows)

    monkeypatch.setattr(StoredIndex, "_write", broken)
    if failing == "version":
        monkeypatch.setattr(StoredIndex, "_finish", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        StoredIndex.open(spark, index.path).update(frame(second))
    monkeypatch.undo()
    left = StoredIndex.open(spark, index.path)
    assert left.version == 1 and state(left) == before
    assert left.recover() == ("forward" if failing == "version" else "nothing" if failing == "postings" else "back")
    fresh = StoredIndex(spark, f"file://{tmp_path}/b")
    fresh.update(frame(second))
    if failing != "version":
        assert state(StoredIndex.open(spark, index.path)) == before and left.recover() == "nothing"
        left.update(frame(second))
    assert state(StoredIndex.open(spark, index.path)) == state(fresh)


def test_derived_tables_are_made_anew_only_for_other_inputs(spark, tmp_path):
    from quarry.plans.derived import Derived, fingerprint

    at = lambda k: f"file://{tmp_path}/{k}"
    for k in range(3):
        (tmp_path / "in" / f"d{k}").mkdir(parents=True)
        (tmp_path / "in" / f"d{k}" / "f.txt").write_text("x\n" * k)
    kept, calls = Derived(spark, at("kept")), []

    def make():
        calls.append(1)
        return spark.read.option("recursiveFileLookup", "true").text(at("in"))

    assert kept.table("t", [at("in")], make).count() == kept.table("t", [at("in")], make).count() == 3 and len(calls) == kept.made == 1
    before = fingerprint(spark, [at("in")])
    (tmp_path / "in" / "d0" / "g.txt").write_text("y\n")
    assert fingerprint(spark, [at("in")]) != before and kept.table("t", [at("in")], make).count() == 4 and len(calls) == 2
    os.rename(tmp_path / "in" / "d0" / "g.txt", tmp_path / "in" / "d1" / "g.txt")
    assert kept.table("t", [at("in")], make).count() == 4 and len(calls) == 3  # another place is another input
    kept.table("t", [at("in")], make, version=2)
    assert len(calls) == 4
    with pytest.raises(ZeroDivisionError):
        kept.folder("u", [at("in")], lambda place: spark.range(1).write.parquet(f"{place}/x") or 1 / 0)
    assert kept.folder("u", [at("in")], lambda place: spark.range(2).write.parquet(f"{place}/x")) and kept.made == 5


def test_line_keys_are_those_of_columns(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(["a", ":12:3", "0xAf", " ", "1234567890123", "node_modules/", ":7)", "internal/", "<anonymous>", "x)"]) for _ in range(rng.randrange(6))) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", text.normalize_line(F.col("l")).alias("k")).collect()
    assert [r.k for r in got] == [logs.line_key(r.l) for r in got]


def test_decayed_sums_of_long_lived_keys(spark):
    rows = [("a", k, float(t)) for k, t in enumerate([0, 1, 2, 499, 500, 501, 1100, 1101, 90_000])]
    got = windows.decayed_sum(spark.createDataFrame(rows, "k string, seq int, t double"), "k", "seq", "t", 1.0).orderBy("seq").collect()
    want = [sum(2.0 ** -(t - x) for _, _, x in rows if x <= t) for _, _, t in rows]
    assert [r.decayed for r in got] == pytest.approx(want)


def test_late_events_are_dropped_and_windows_close(spark, tmp_path):
    from quarry.streaming.events import EVENTS, run, windowed

    def put(name, rows):
        frame = spark.createDataFrame([(k, t, 1, "view", 1.0, "{}") for k, t in rows], EVENTS.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")

    put("a", [(1, "2024-01-01 00:10:00"), (2, "2024-01-01 05:00:00")])
    put("b", [(3, "2024-01-02 00:00:00")])
    put("c", [(7, "2024-01-02 01:00:00")])
    put("d", [(4, "2024-01-01 00:20:00"), (5, "2024-01-03 00:00:00")])  # the first one is a day late
    put("e", [(6, "2024-01-04 00:00:00")])
    import os
    import time as clock

    for k, name in enumerate("abcde"):
        for base, _, files in os.walk(f"{tmp_path}/{name}"):
            for f in files:
                os.utime(os.path.join(base, f), (clock.time() - 1000 + 10 * k,) * 2)
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").parquet(str(tmp_path))
    out = run(windowed(rows.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours"), "append")
    assert sorted((str(r.start), r.n) for r in out.collect()) == [("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 2), ("2024-01-03 00:00:00", 1)]


def test_two_sides_of_a_graph():
    from quarry.plans.spectral import bipartition

    pairs = [(i + a, j + a) for a in (0, 5) for i in range(5) for j in range(i)] + [(0, 5)]
    u, v = np.array(pairs).T
    sides = bipartition(spectrum(10, u, v, np.ones(len(u))), set(range(10)))
    inner = [x for k, x in enumerate(sides) if k not in (0, 5)]
    assert len(set(inner[:4])) == len(set(inner[4:])) == 1 and inner[0] != inner[-1]


def test_connectivity_of_feature_rows():
    from quarry.plans.spectral import commit_connectivity

    assert commit_connectivity(5, *edges(5, "clique")) == pytest.approx(1.25)
    assert commit_connectivity(26_000, *edges(5, "clique")) == 0.5
    assert commit_connectivity(26_000, np.array([], int), np.array([], int), np.array([])) == 0.0


def trade_pairs(spark):
    from quarry.sources.tables import trade

    return sorted((r.src, r.dst) for r in trade(spark, SF_DIR).collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no data")
def test_spectrum_of_an_ego_graph_equals_brute_force(spark):
    got = QUERIES["c22_trade_spectrum_ego"](spark, SF_DIR).first()
    pairs = trade_pairs(spark)
    own = {frozenset(p) for p in pairs if 3 in p}
    near = sorted({x for p in own for x in p})
    weights = {frozenset(p) for p in own}
    lap = np.zeros((len(near), len(near)))
    for p in weights:
        i, j = (near.index(x) for x in p)
        lap[[i, j], [j, i]] -= 1
        lap[[i, j], [i, j]] += 1
    assert got["lambda2"] == pytest.approx(sorted(np.linalg.eigvalsh(lap))[1], abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no data")
def plain_audit(nodes, pairs, have, n_errors, scores, sessions):
    """The parts, the index, the projected index and the issues, from their definitions."""
    n, at = len(nodes), {x: k for k, x in enumerate(nodes)}
    a = np.zeros((n, n))
    for s, t in pairs:
        a[at[s], at[t]] = a[at[t], at[s]] = 1
    d = a.sum(0)
    low = np.linalg.eigvalsh(np.diag(d) - a)
    inv = 1 / np.sqrt(np.where(d > 0, d, 1))
    norm = np.linalg.eigvalsh(np.diag((d > 0).astype(float)) - a * np.outer(inv, inv))
    rank = np.full(n, 1 / n)
    out = collections.Counter(s for s, _ in pairs)
    for _ in range(20):
        new = np.full(n, 0.15 / n + 0.85 * sum(rank[at[x]] for x in nodes if not out[x]) / n)
        for s, t in pairs:
            new[at[t]] += 0.85 * rank[at[s]] / out[s]
        rank = new
    pr = np.round(rank / rank.max(), 10)
    p = pr / pr.sum()
    s = math.log10(max(10, n) / 300)
    cutoff = np.sort(pr)[int(n * min(0.995, max(0.85, 0.91 + 0.05 * s)))]
    into = collections.Counter(t for _, t in pairs)
    core = [x for x in nodes if into[x] and pr[at[x]] >= cutoff]
    up = lambda x, t0, t1, t2: 1.0 if x >= t0 else 0.7 + 0.3 * (x - t1) / (t0 - t1) if x >= t1 else 0.4 + 0.3 * (x - t2) / (t1 - t2) if x >= t2 else max(0.1, 0.4 - 0.3 * (t2 - x) / (t1 - t2))
    down = lambda x, t0, t1, t2: 1.0 if x <= t0 else 1.0 - 0.3 * (x - t0) / (t1 - t0) if x <= t1 else 0.7 - 0.3 * (x - t1) / (t2 - t1) if x <= t2 else max(0.1, 0.4 - 0.3 * (x - t2) / (t2 - t1))
    lambda2 = 0.0 if abs(low[1]) < 1e-9 else low[1]
    gap = norm[2] - norm[1]
    gap = math.copysign(math.log1p(abs(gap / (len(pairs) / (n * (n - 1))))), gap)
    weak = [x for x in core if scores.get(x, 0) >= 15]
    ratio = lambda k: k / len(core) if core else 1.0
    done = len(set(core) & have)
    entropy = -sum(x * math.log(x) for x in p if x > 0) / math.log(n)
    parts = {"coupling": (0.1 if lambda2 == 0 else down(lambda2 / (2 * len(pairs) / n), 0.05, 0.15, 0.5), 0.2), "gap": (up(gap, 3.69, 3.31, 2.69), 0.05), "spread": (entropy, 0.25), "errors": (down(n_errors / n, 0.0, 0.05, 0.15), 0.2), "coverage": (up(ratio(done), 0.9, 0.7, 0.4), 0.2), "stability": ({0: 1.0, 1: 0.7, 2: 0.7}.get(len(weak), 0.4 if len(weak) <= 5 else 0.1), 0.1 if sessions >= 5 else 0.0)}
    index = lambda **other: math.floor(sum(other.get(k, v) * w for k, (v, w) in parts.items()) / sum(w for _, w in parts.values()) * 100 + 0.5) / 10
    impact = round(index(coverage=up(ratio(min(done + 1, len(core))), 0.9, 0.7, 0.4)) - index(), 1)
    issues = {(x, "untested", "critical" if into[x] > 20 else "high" if into[x] > 5 else "medium", impact) for x in core if x not in have}
    if sessions >= 5:
        issues |= {(x, "fragile", "critical" if scores[x] > 30 else "high", 0.0) for x in weak}
    return parts, index(), index(coverage=1.0), issues


@pytest.mark.parametrize("seed,sessions", [(1, 7), (2, 7), (3, 2)])
def test_health_audit_equals_brute_force(spark, seed, sessions):
    from quarry.plans.audit import audit

    rng = random.Random(seed)
    nodes = [f"f{k}" for k in range(60)]
    pairs = {(f"f{rng.randrange(60)}", f"f{min(rng.randrange(60), rng.randrange(60), rng.randrange(60))}") for _ in range(150)}
    pairs = {(s, t) for s, t in pairs if s != t}
    have, scores = {x for x in nodes if rng.random() < 0.5}, {x: rng.randrange(40) for x in nodes if rng.random() < 0.6}
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    rows, issues = audit(frame([(x,) for x in nodes], "node string"), frame([*pairs, ("f1", "f1")], "src string, dst string"), frame([(x,) for x in have], "node string"), frame([(3 * seed,)], "n long"), frame([(x, float(v)) for x, v in scores.items()], "node string, score double"), sessions)
    got = {r.part: r for r in rows.collect()}
    parts, index, projected, found = plain_audit(nodes, pairs, have, 3 * seed, scores, sessions)
    assert {k: (r.score, r.weight) for k, r in got.items()} == {k: pytest.approx(v, abs=1e-5) for k, v in parts.items()}
    assert all((r["index"], r.projected) == (pytest.approx(index), pytest.approx(projected)) for r in got.values())
    assert {(r.node, r.kind, r.severity, round(r.impact, 1)) for r in issues.collect()} == found


def test_health_audit_of_little(spark):
    from quarry.plans.audit import audit

    none = spark.createDataFrame([], "node string")
    rows, issues = audit(none, spark.createDataFrame([], "src string, dst string"), none)
    assert {r.part: r.weight for r in rows.collect()} == {"coupling": 0.2, "gap": 0.0, "spread": 0.25, "coverage": 0.3} and issues.count() == 0
    one = spark.createDataFrame([("a",)], "node string")
    assert audit(one, spark.createDataFrame([], "src string, dst string"), none)[0].where("part = 'coupling'").first().score == 0.7


def test_levels_of_compression():
    from quarry.functions.compress import compress, key_references, structure

    body = "import x from './y'\nfunction f(a) {\n  const b = go(a);\n  other();\n  if (a) { this.x = new Y(); }\n  return log.it(b);\n}\nif (x) {\n  y();\n}\n" + "const one = 1\n"
    assert structure(body, ".ts", "medium", "p.ts") == "// p.ts | medium | 2 chunks\nimport x from './y'\n[func] function f(a) { /* L2-L7 */ }\n  // Key lines:\n  const b = go(a);\n  if (a) { this.x = new Y(); }\n  return log.it(b);\n[var] const one = 1\n  // Key lines:\n  const one = 1"
    assert structure(body, ".ts", "aggressive", "p.ts") == "// p.ts | aggressive | 2 chunks\nimport x from './y'\n[func] function f(a) { /* L2-L7 */ }\n/*[6L refs:f,go,other,Y,log.it]*/\nif (x) {\n  y();\n}\nconst one = 1\n"
    assert structure("no code", ".md", "medium", "p.md") == "no code" and compress("", ".ts", "aggressive", {}) == ""
    nested = "class A {\n  m() {\n" + "    call();\n" * 9 + "  }\n}\ntail();\n"
    assert structure(nested, ".ts", "aggressive", "a").endswith("[class] class A { /* L1-L13 */ }\n/*[13L refs:m,call]*/\ntail();\n")
    long = body.replace("other();", "other();\n" * 40)
    assert compress(long, ".ts", "aggressive", {}, "p.ts") == structure(long, ".ts", "aggressive", "p.ts")  # shorter than its kept words
    assert len(compress(long, ".ts", "medium", {}, "p.ts")) <= len(structure(long, ".ts", "medium", "p.ts"))
    assert key_references("a(); b.c(); if (x) {} d(); e(); f(); g()") == ["a", "b.c", "d", "e", "f"]
    assert compress("#!/usr/bin/env x\ndef f():\n    \'\'\'doc # no\'\'\'\n    return \'#1\'  # c\n", ".py", "light", {}) == "#!/usr/bin/env x\ndef f():\n    \'\'\n    return \'#1\'\n"


def test_words_are_pruned_by_score_and_protected():
    from quarry.functions.compress import kept_words, prune, scored

    text_ = "return the the value of Thing (x) a.b 12 the"
    words = scored(text_, 0.5, {"the": 0.07, "of": 0.03})
    safe = {text_[a:b] for a, b, _, p in words if p}
    assert safe == {"return", "the", "Thing", "(x)", "a.b", "12"} and [p for *_, p in words][:3] == [True, True, False]
    assert [text_[a:b] for a, b, *_ in kept_words(words, 0.5)] == ["return", "the", "value", "of", "Thing", "(x)", "a.b", "12"]
    assert prune("a  b\n\n\n\nc", 0.0, 0.5, {}) == "a b\n\nc" and prune("", 0.5, 0.5, {}) == ""


def test_committed_tables_and_candidates(spark, tmp_path):
    from quarry.sources.maintenance import commit_tables, first_existing, last_version, read_committed

    root = f"file://{tmp_path}/t"
    assert last_version(spark, root) == 0 and read_committed(spark, root, "a", "id long").count() == 0
    commit_tables(spark, root, 1, {"a": spark.range(3), "b": spark.range(2)})
    spark.range(9).write.parquet(f"{root}/v00000002/a")  # never finished
    assert last_version(spark, root) == 1 and read_committed(spark, root, "a", "id long").count() == 3
    commit_tables(spark, root, 2, {"a": spark.range(4)})  # and tried again
    assert read_committed(spark, root, "a", "id long").count() == 4
    assert first_existing(spark, [f"{root}/none", f"{root}/v00000001", root]) == f"{root}/v00000001"
    assert first_existing(spark, [f"{root}/none"]) is None


@pytest.mark.parametrize(("raw", "name"), [("export async function go(a)", "go"), ("private static get size()", "size"), ("class Box<T>", "Box"), ("def run(self)", "run"), ("func (s *T) Serve(a int)", "Serve"), ("const a = 1", "a"), ("(", "")])
def test_declared_names(raw, name):
    from quarry.functions.structure import declared_name

    assert declared_name(raw) == name


def test_tests_are_met_by_name_and_by_import(spark):
    files = [f"src/{n}" for n in ("a.ts", "a.b.ts", "deep/c-d.tsx", "e.js", "f.py", "g.mts", "unused.ts", "x.ts")]
    tests = [("t/a.b.test.ts", None), ("t/q.spec.js", "import {\n z,\n} from '../src/deep/c-d.js'\n// import './unused'\n/* require('./unused')\n*/"), ("t/r.test.ts", "const e = require(\"./e\")"), ("t/s.test.ts", "\n" * 50 + "import './x'"), ("t/u.test.ts", "import './xx'; import './unused2'; from 'g.mts'")]
    got = relations.tested(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(tests, "path string, code string"))
    assert sorted(r.path for r in got.collect()) == ["src/a.b.ts", "src/deep/c-d.tsx", "src/e.js", "src/g.mts"]
    assert relations.tested(got.limit(0), spark.createDataFrame(tests, "path string, code string")).count() == 0


@pytest.mark.parametrize("text", ["a", "../src/a-b.c", "--", "", "x..y", "a b"])
def test_whole_parts_are_what_word_boundaries_allow(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(relations.whole_parts(F.col("t")).alias("p")).first().p
    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    want = {p for p in parts if any(m.start() < m.end() for m in re.finditer(rf"\b{re.escape(p)}\b", text))}
    assert set(got) == want


def test_pins_are_refused_for_each_reason(spark):
    from quarry.plans.composites import pin_admission

    texts = {"ok": None, "  ": "empty", "x" * 201: "long", "a\0b": "nul", "Http://a": "url", "ｈｔｔｐ://a": "url", "ａ/../b": "traversal", "evaluate (x)": None, "$(x)": "substitution", "`$(x)`": "substitution", None: "empty"}
    rows = pin_admission(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: r.reason for r in rows} == texts


@pytest.mark.parametrize(
    "ext,source,want",
    [
        (".ts", "import type { Abc, type Def as D1 } from '@/x/y.tsx';\nimport Foo, { zed } from '../foo.js'\nimport * as all from '~/all'\nimport React from 'react'\nimport { ab } from './short'", {("Abc", "Abc", "y"), ("Def", "D1", "y"), ("Foo", "Foo", "foo"), ("all", "all", "all")}),
        (".js", "const { one: uno, two } = require('./m');\nvar { three } = require('fs')", {("one", "uno", "m"), ("two", "two", "m")}),
        (".py", "from a.b import (One as X,\n  Two)\nfrom os import path\nimport json, django.db as db, numpy\njson.loads(x)\ndb.models.Q; numpy.array(1); mydb.other", {("One", "X", "b"), ("Two", "Two", "b"), ("path", "path", "os"), ("models", "db.models", "db"), ("array", "numpy.array", "numpy")}),
        (".go", 'import (\n "fmt"\n m "github.com/x/y/models"\n _ "github.com/x/z"\n)\nimport "example.org/util"\nfunc f() { fmt.Println(m.User{}, util.Do(), util.private, m.User) }', {("User", "m.User", "models"), ("Do", "util.Do", "util")}),
    ],
)
def test_dependencies_of_a_source(ext, source, want):
    from quarry.functions.structure import dependencies

    assert set(dependencies(source, ext)) == want and len(dependencies(source, ext)) == len(want)


def test_outline_of_odd_rows(spark):
    from quarry.plans.definitions import define_chunks
    from quarry.plans.outline import outline_rows, outline_texts

    risky = "export function processPrice%d(v: any) {\n  for (const r of v) { if (r) { v.push(r * 2); } }\n  return v.a * v.b - v.c / 2;\n}\n"
    rows = [("a.ts", "export class Used {}\nexport function alone() { return 1 }\nfunction local() {}\n" + "".join(risky % k for k in range(5))), ("index.ts", "export const entry = () => 1;"), ("b.ts", "new Used(); export type T = 1; export function _p() {}"), ("c.ts", None), ("d.md", "x")]
    files = spark.createDataFrame(rows, "path string, code string")
    notes = spark.createDataFrame([("a.ts", "local", "assert it", "no"), ("a.ts", "Used", "stale one", "no"), ("a.ts", "none", "x", "y"), (None, None, None, None)], "path string, name string, insight string, hash string")
    got = {r.name: r for r in outline_rows(files, define_chunks(files), notes, budget=90).collect()}
    assert {n for n, r in got.items() if r.ghost} == {"alone", *(f"processPrice{k}" for k in range(5))}
    assert [n for n, r in sorted(got.items()) if r.expanded] == ["processPrice0", "processPrice1"]
    assert (got["local"].note, got["Used"].note, got["Used"].stale, got["Used"].folded, got["local"].folded, got["entry"].folded) == ("assert it", None, True, True, False, True)
    texts = {r.path: r.text for r in outline_texts(outline_rows(files, define_chunks(files), notes)).collect()}
    assert set(texts) == {"a.ts", "index.ts", "b.ts"} and texts["a.ts"].endswith("1 of low risk: Used") and "func local [LOW] L3-L3\n  note: assert it" in texts["a.ts"]
    assert outline_rows(files.limit(0), define_chunks(files.limit(0)), notes).count() == 0


def test_places_in_a_total_order(spark):
    from quarry.plans.order import numbered, values_at

    rng = random.Random(9)
    rows = [(rng.choice([None, 0.0, 0.0, 0.0, rng.random()]), k) for k in range(400)]
    frame = spark.createDataFrame(rows, "v double, k long").repartition(7)
    want = [k for _, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))]
    assert [r.k for r in sorted(numbered(frame, ["v", "k"]).collect(), key=lambda r: r.place)] == want
    values = dict((k, v) for v, k in rows)
    places = [0, 1, 57, 200, 399]
    assert values_at(frame, "v", "k", [*places, 400]) == [*(values[want[p]] for p in places), None]
    assert numbered(frame.limit(0), ["v", "k"]).count() == 0 and values_at(frame.limit(0), "v", "k", [0]) == [None]
