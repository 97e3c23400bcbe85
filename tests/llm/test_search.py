"""The searches over vectors and texts against brute force, their bounds, and odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_search, hard_negatives, lexical_search, vectors

VECTORS = "vec_id long, embedding array<float>, label int, row string, vec string, table string, lane int, score string, positives string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n, "r", "v", "t", 3, "s", "p") for i, v, n in rows], VECTORS)


def scaled(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def takes_part(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def clustered(rng, n, dims=16, clusters=12):
    centres = rng.normal(size=(clusters, dims))
    return [(centres[k % clusters] + 0.05 * rng.normal(size=dims)).astype(np.float32).tolist() for k in range(n)]


def odd_vectors():
    """Ties, repeated rows, nulls of every kind, no components, another length, a hot id."""
    rng = random.Random(5)
    rows = [(k, [rng.choice([-0.5, 0.25, 0.5]) for _ in range(4)], k % 3) for k in range(120)]
    rows += [(100, [0.5, 0.5, 0.25, 0.25], 1)] * 30 + [(None, [0.5, 0.5, 0.5, 0.5], 1), (200, None, 1), (300, [None, 0.5, 0.5, 0.5], 0)]
    rows += [(400, [math.nan, 0.1, 0.1, 0.1], 2), (500, [math.inf, 0.1, 0.1, 0.1], 2), (600, [], 1), (700, [], 2), (800, [0.5, 0.5], 1), (801, [0.5, 0.25], 2), (802, [0.5, 0.125], 1), (900, [0.25] * 4, None)]
    return rows


# --- vectors --------------------------------------------------------------------------


def test_products_are_exact_for_any_size():
    rng = np.random.default_rng(2)
    a = np.floor(rng.normal(size=(6, 5)) * np.array([1, 10, 1e9, 1e12, 1e17, 1e30])[:, None])
    got = vectors.products(a, a)
    for i in range(6):
        for j in range(6):
            want = dot(list(map(int, a[i])), list(map(int, a[j])))
            assert got[i, j] == min(vectors.MOST, max(vectors.LEAST, want))


# --- exact search ---------------------------------------------------------------------


def brute_top(rows, every=100, k=10, scale=1024):
    own = [(i, scaled(v, scale)) for i, v, _ in rows if takes_part(v)]
    out = []
    for a, (i, v) in enumerate(own):
        if i is not None and i % every == 0:
            found = sorted((-dot(v, w), math.inf if j is None else j) for b, (j, w) in enumerate(own) if b != a and len(v) == len(w))
            out += [(i, r, None if j == math.inf else j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("every", [100, 7])
def test_exact_search_equals_brute_force(spark, every):
    rows = odd_vectors()
    got = exact_search.exact_top_k(frame(spark, rows).repartition(5), every)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_top(rows, every)


def test_exact_search_of_huge_and_random_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (v if k % 9 else np.array(v) * 1e14).tolist() if k % 9 == 0 else v, 0) for k, v in enumerate(clustered(rng, 240))]
    want = brute_top(rows, 20)
    got = exact_search.exact_top_k(frame(spark, rows), 20).collect()
    clip = lambda s: min(vectors.MOST, max(vectors.LEAST, s))
    assert [(r.query_id, r.rank) for r in sorted(got)] == [(q, n) for q in range(0, 240, 20) for n in range(1, 11)]
    small = {q for q in range(0, 240, 20) if q % 9}
    for w in want:
        q, rank, j, s = eval(w)
        if q in small and abs(s) < vectors.MOST:
            assert (q, rank, j, clip(s)) in {tuple(r) for r in got}


def test_bounds_eliminate_rows_and_lose_none():
    rng = np.random.default_rng(7)
    x = np.floor(np.array(clustered(rng, 4000)) * 1024)
    pivots = exact_search.choose_pivots(x[:500], 32)
    table, ids = exact_search.distances(x, pivots), np.arange(len(x))
    evaluated = []
    for q in range(0, 4000, 97):
        rows, scores, n = exact_search.top_by_bounds(x[q], table[q], x, table, ids, 10, q)
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[q]) if j != q)[:10]
        assert [(-s, j) for j, s in zip(rows.tolist(), scores.tolist(), strict=True)] == want
        evaluated.append(n)
    assert np.mean(evaluated) < 0.3 * len(x)


def test_pivots_are_apart_and_equal_rows_give_one():
    assert len(exact_search.choose_pivots(np.ones((50, 3)), 8)) == 1
    chosen = exact_search.choose_pivots(np.array([[0.0], [1], [2], [9], [10]]), 3)
    assert chosen[:, 0].tolist() == [0, 10, 2]


# --- hard negatives -------------------------------------------------------------------


def brute_negatives(rows, every=100, p=5, k=5, share=80, scale=256):
    own = [(i, scaled(v, scale), n) for i, v, n in rows if takes_part(v) and n is not None]
    key = lambda x: (-x[0], math.inf if x[1] is None else x[1])
    out = []
    for a, (i, v, label) in enumerate(own):
        if i is not None and i % every == 0:
            met = [(dot(v, w), j, n) for b, (j, w, n) in enumerate(own) if b != a and len(v) == len(w)]
            for ps, pid, _ in sorted((x for x in met if x[2] == label), key=key)[:p]:
                near = sorted((x for x in met if x[2] != label and share * ps <= 100 * x[0] <= 100 * ps), key=key)[:k]
                out += [(i, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(near, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("every", [100, 7])
def test_hard_negatives_equal_brute_force(spark, every):
    rows = odd_vectors()
    got = hard_negatives.hard_negatives(frame(spark, rows).repartition(3), every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, every)
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) > 20


def test_hard_negatives_of_different_norms_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(k, (np.array(v) * math.exp(rng.normal())).astype(np.float32).tolist(), int(rng.integers(4))) for k, v in enumerate(clustered(rng, 400))]
    got = hard_negatives.hard_negatives(frame(spark, rows), 10).collect()
    want = brute_negatives(rows, 10)
    assert sorted(str(tuple(r)) for r in got) == want and len(want) > 100


def test_buckets_are_pruned_by_norm():
    rng = np.random.default_rng(13)
    x = np.floor(rng.normal(size=(8000, 16)) * np.exp(rng.normal(size=(8000, 1)) * 1.5) * 256)
    labels, at = np.ones(8000, dtype=np.int64), np.arange(8000)
    (own,) = hard_negatives.buckets(x, at, labels)
    assert [b.longest for b in own] == sorted((b.longest for b in own), reverse=True) and sum(len(b.rows) for b in own) == 8000
    asked = x[:40]
    for windows in ([[hard_negatives.Best(5)] for _ in asked], [[hard_negatives.Best(5, 10**7, 10**8)] for _ in asked]):
        made = hard_negatives.sweep(own, asked, windows, at)
        for a, (w,) in zip(asked, windows, strict=True):
            scores = (x @ a).astype(np.int64)
            inside = [(-int(s), j, j) for j, s in enumerate(scores) if w.low is None or w.low <= s <= w.high]
            assert w.kept == sorted(inside)[:5]
        assert made < 0.6 * len(x) * len(asked)


def test_windows_of_any_sign():
    for p in range(-30, 31):
        least = hard_negatives.lower_limit(p)
        assert 80 * p <= 100 * least and 80 * p > 100 * (least - 1)


# --- lexical search -------------------------------------------------------------------


def brute_lexical(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in texts if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in held:
            tf, m = Counter(t), 10 + (90 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in set(terms(text)) if tf[w])
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


DOCS = "doc_id long, text string, item string, score string, rank string, id string, salt string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(17)
    word = lambda: f"{rng.choice(['w', 'W', 'É', 'ß', '日'])}{min(rng.randrange(60), rng.randrange(60))}"
    rows = [(k, rng.choice([" ", ", ", "\n", "--"]).join(word() for _ in range(rng.randrange(1, 80)))) for k in range(200)]
    rows += [(500, "w1 w2 w3")] * 25 + [(None, "w1 w2"), (None, "w1 w2"), (501, None), (502, ""), (503, " \n~{}"), (504, "x" * 200_000 + " w3"), (505, "w4 " * 60_000), (506, "Ａ w5 w6")]
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 9, 40, 200])] + [(7, None), (8, ""), (9, "..."), (None, "w3"), (3, "w3 W3 w3"), (3, "w3"), (10, "nosuchword"), (11, "w4")]
    return rows, items


def test_lexical_search_equals_brute_force(spark, texts):
    rows, items = texts
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.lexical_search(documents(spark, rows).repartition(6), bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_lexical(rows, items)


def test_blocks_and_chunks_do_not_change_ranks(spark, texts, monkeypatch):
    rows, items = texts
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "CHUNK", 50)
    assert sorted(str(tuple(r)) for r in lexical_search.lexical_search(documents(spark, rows), bench).collect()) == brute_lexical(rows, items)


def test_terms_are_not_cut_by_pieces():
    rng = random.Random(19)
    text = "".join(rng.choice(["a", "B", " ", ".", "é", "_", "日"]) for _ in range(3000)).encode()
    want = [t.lower().encode() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t).encode() for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.decode())]
    for piece in (1, 7, 100, 10_000):
        assert [t for part in lexical_search.terms_of(text, piece) for t in part] == want


def test_sums_by_radix_sort_equal_a_dictionary():
    rng = np.random.default_rng(23)
    for n_items, n_docs in ((1, 1), (5, 300), (70_000, 3), (3000, 4000)):
        items, docs, impacts = rng.integers(n_items, size=2000), np.sort(rng.integers(n_docs, size=2000)), rng.integers(-50, 10**12, size=2000)
        want = Counter()
        for i, d, x in zip(items.tolist(), docs.tolist(), impacts.tolist(), strict=True):
            want[i, d] += x
        got = lexical_search.accumulate(items, docs, impacts, n_docs, n_items)
        assert list(zip(*(c.tolist() for c in got), strict=True)) == [(i, d, want[i, d]) for i, d in sorted(want)]


# --- all of them ----------------------------------------------------------------------


def test_empty_tables_give_empty_tables(spark):
    none = frame(spark, odd_vectors()).limit(0)
    assert exact_search.exact_top_k(none).count() == 0 and hard_negatives.hard_negatives(none).count() == 0
    only_null = frame(spark, [(100, None, None), (None, [0.5], 1)])
    assert exact_search.exact_top_k(only_null).count() == 0 and hard_negatives.hard_negatives(only_null).count() == 0
    docs = documents(spark, [(1, "a"), (2, None)])
    bench = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical_search.lexical_search(docs.limit(0), bench).count() == 0
    assert lexical_search.lexical_search(docs, bench.limit(0)).count() == 0
    assert lexical_search.lexical_search(docs.where("text is null"), bench).count() == 0


def test_each_search_equals_its_sql(spark):
    import duckdb

    from quarry.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op11_exact_search", "op12_hard_negatives", "op13_lexical_search"):
        df = QUERIES[name](spark, sf)
        found = c.execute(ORACLE_SQL[name])
        cols = [d[0] for d in found.description]
        assert sorted(map(tuple, df.select(cols).collect())) == sorted(found.fetchall())
        assert df.agg(F.count("*")).first()[0] > 0
