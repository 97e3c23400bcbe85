"""Feature rows of histories against a plain replay, whatever the batches."""

import json
import math
import random
import statistics

import numpy as np
import pytest

from quarry.streaming import snapshots
from quarry.streaming.events import run

SCHEMA = "repo string, seq long, ts long, subject string, changes array<struct<file:string,op:string,imports:array<string>>>"


def history(rng, n=60, files=30):
    names = [f"d{k % 7}/f{k}.ts" for k in range(files)]
    out, ts = [], 1_600_000_000
    for seq in range(n):
        ts += rng.choice([60, 3600, 86_400, 700_000])
        some = rng.sample(names, rng.choice([4, files - 2, files - 2] if seq % 9 == 8 else [1, 2, 3]))
        changes = [{"file": f, "op": rng.choice("AMMMD") if len(some) < 9 else "M", "imports": rng.choice([None, rng.sample(names, rng.randrange(4))])} for f in some]
        out.append((seq, ts, rng.choice(["feat: x", "Fix style", "typo", "lintel"]), changes))
    return out


def replay(commits):
    """Each snapshot from the whole past, without state: sizes, churn, graph and labels."""
    found, sizes, past = [], [], []
    for k, (seq, ts, subject, changes) in enumerate(commits):
        files = {}
        for _, _, _, cs in commits[: k + 1]:
            for c in cs:
                files.pop(c["file"], None)
                if c["op"] != "D":
                    files[c["file"]] = c["imports"] or []
        if len(files) < 2:
            continue
        touched = [c["file"] for c in changes]
        past.append((ts, touched))
        sizes.append(math.log(len(touched)))
        edges = {(f, t) for f, ts_ in files.items() for t in ts_ if t in files and t != f}
        if not edges:
            continue
        folders = [f.split("/")[0] for f in touched]
        entropy = -sum(folders.count(d) / len(folders) * math.log2(folders.count(d) / len(folders)) for d in set(folders))
        ordered = sorted(sizes)
        median = ordered[len(ordered) // 2]
        mad = sorted(abs(x - median) for x in sizes)[len(sizes) // 2]
        z = 0.6745 * (sizes[-1] - median) / max(mad, 0.45) if len(sizes) >= 10 else 0.0
        shotgun = len(sizes) >= 10 and z > 3 and entropy > 2 and len(touched) >= max(8, math.floor(math.exp(ordered[min(int(len(ordered) * 0.995), len(ordered) - 1)])))
        names = sorted(files)
        pr = {f: 1 / len(names) for f in names}
        out = {f: [t for s, t in edges if s == f] for f in names}
        for _ in range(20):
            leak = sum(pr[f] for f in names if not out[f])
            pr = {f: 0.15 / len(names) + 0.85 * (sum(pr[s] / len(out[s]) for s, t in edges if t == f) + leak / len(names)) for f in names}
        top = max(pr.values())
        pr = {f: x / top for f, x in pr.items()}
        churn = {}
        for t, fs in past:
            for f in fs:
                churn[f] = churn.get(f, 0) + 0.5 ** ((ts - t) / 3600 / 72)
        hub = sorted(pr.values())[math.floor(len(names) * 0.9)]
        found.append({"seq": seq, "n": len(names), "edges": len(edges), "entropy": entropy, "z": z, "shotgun": shotgun, "cosmetic": any(w in subject.lower().split() for w in ("style", "typo")), "pr": pr, "churn": churn, "touched": touched, "quiet": [f for f in touched if pr.get(f, 0) <= hub or f not in pr], "links": edges})
    for k, x in enumerate(found):
        later = [(j, y) for j, y in enumerate(found[k + 1 : k + 11], 1) if y["shotgun"] and not y["cosmetic"] and set(y["touched"]) & set(x["quiet"])]
        x["label"] = (1, math.log1p(len(later[0][1]["touched"])), later[0][0]) if later else (0, 0.0, 10)
    return found[: max(0, len(found) - 10)]


@pytest.fixture(scope="module")
def commits():
    rng = random.Random(7)
    return {"a": history(rng, 70), "b": history(rng, 40), "short": history(rng, 8)}


def rows_of(commits):
    return [(repo, *c) for repo, cs in commits.items() for c in cs]


def test_rows_equal_a_plain_replay(spark, tmp_path, commits):
    rows = [*rows_of(commits), (None, 1, 2, "x", [{"file": "f", "op": "A", "imports": None}]), ("none", 1, 2, None, []), ("void", 1, 2, "x", None)]
    rng, got = random.Random(3), []
    # Three runs with one state; some commits come again.
    for k, (lo, hi) in enumerate(((0, 25), (25, 33), (30, 99))):
        part = [r for r in rows if lo <= r[1] < hi]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*")
        got += run(snapshots.feature_stream(stream), "append", checkpoint=f"{tmp_path}/state").collect()
    assert {r.repo for r in got} == {"a", "b"}
    labels = set()
    for repo in ("a", "b"):
        own, want = sorted((r for r in got if r.repo == repo), key=lambda r: r.seq), replay(commits[repo])
        assert [(r.seq, r.n, r.edges, r.shotgun) for r in own] == [(x["seq"], x["n"], x["edges"], x["shotgun"]) for x in want]
        for r, x in zip(own, want, strict=True):
            labels.add(r.collapse)
            assert (r.entropy, r.robust_z, r["size"], r.density) == pytest.approx((x["entropy"], x["z"], x["label"][1], x["edges"] / (x["n"] * (x["n"] - 1))))
            assert (r.collapse, r.tte) == (x["label"][0], x["label"][2])
            nodes = {n.id: n for n in r.nodes}
            assert {f: n.pr for f, n in nodes.items()} == pytest.approx(x["pr"])
            assert all(n.churn == pytest.approx(x["churn"].get(f, 0.0), abs=0.02) for f, n in nodes.items())
            # The second vector is one of the Laplacian of the linked files, and isolated files have none.
            linked = sorted({f for e in x["links"] for f in e})
            a = np.zeros((len(linked), len(linked)))
            for s, t in x["links"]:
                a[linked.index(s), linked.index(t)] = a[linked.index(t), linked.index(s)] = 1
            d = a.sum(0)
            lap = np.eye(len(linked)) - a / np.sqrt(np.outer(d, d))
            values = np.linalg.eigvalsh(lap)
            for k, c in ((1, "v2"), (2, "v3")):
                if len(linked) > k:
                    v = np.array([nodes[f][c] for f in linked])
                    assert np.allclose(lap @ v, values[k] * v, atol=1e-6) and abs(v @ v - 1) < 1e-6
            assert all(nodes[f].v2 == 0 for f in set(nodes) - set(linked))
            if len(values) > 2:
                ratio = (values[2] - values[1]) / r.density
                assert r.gap == pytest.approx(math.log1p(abs(ratio)) if ratio > 1e-7 else 0.0, abs=1e-6)
    assert labels == {0, 1}


def test_vectors_are_turned_as_those_before(spark, commits):
    h, before = snapshots.History(), {}
    for seq, ts, _, changes in commits["a"]:
        list(h.commit(seq, ts, False, changes))
        if before and h.vectors and h.vectors is not before:
            assert sum(before[f][0] * h.vectors[f][0] for f in h.vectors if f in before) >= -1e-12
        before = dict(h.vectors)
        assert json.loads(snapshots.History(h.dump()).dump()) == json.loads(h.dump())


def test_large_commits():
    files = [{"file": f"d{k % 50}/f{k}.ts", "op": "A", "imports": [f"d{(k + 1) % 50}/f{k + 1}.ts"]} for k in range(900)]
    h = snapshots.History()
    assert list(h.commit(0, 100, False, files)) == [] and len(h.files) == 900 and [w["features"] for w in h.waiting] == [None] and h.sizes == []
    assert list(h.commit(1, 200, False, [{**f, "op": "M"} for f in files])) == [] and len(h.waiting) == 1 and h.churn == {}
    for seq in range(2, 14):
        got = list(h.commit(seq, 300 + seq, False, files[:2]))
        assert bool(got) == (seq >= 12)  # the ghost leaves without a row
    assert len(h.waiting) == 10 and statistics.fmean(h.churn.values()) == pytest.approx(12, rel=0.01)


def test_queries_agree_with_each_other(spark):
    from quarry.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    nodes = {(r.repo, r.seq): r.n for r in QUERIES["r17_feature_nodes"](spark, sf).groupBy("repo", "seq").count().withColumnRenamed("count", "n").collect()}
    assert nodes == {(r.repo, r.seq): r.n for r in QUERIES["r17_commit_features"](spark, sf).collect()}


def test_commits_of_any_size_have_plain_rows_if_no_limit_is_set():
    files = [{"file": f"d{k % 50}/f{k}.ts", "op": "A", "imports": [f"d{(k + 1) % 50}/f{k + 1}.ts"]} for k in range(900)]
    h, out = snapshots.History(None, None, True), []
    for seq in range(12):
        out += h.commit(seq, 100 + seq, False, files)
        h = snapshots.History(h.dump(), None, True)
    assert [(r[0], r[1], r[2], r[-1]) for r in out] == [(0, 900, 899, []), (1, 900, 899, [])]


def test_runs_hold_a_bounded_number_of_changes():
    assert snapshots.runs_of([]) == [] and snapshots.runs_of([(3, 10)]) == [(3, 3)]
    assert snapshots.runs_of([(1, 4), (2, 4), (3, 4), (4, 4)]) == [(1, 2), (3, 4)]
    assert snapshots.runs_of([(k, 5) for k in range(7)], most=11) == [(0, 1), (2, 3), (4, 5), (6, 6)]
    assert snapshots.runs_of([(1, 50), (2, 1), (3, 1)], most=10) == [(1, 1), (2, 3)]


def test_graphs_of_any_size_have_vectors():
    from quarry.plans.spectral import MAX_NODES

    n = MAX_NODES + 1
    files = [{"file": f"d{k % 50}/f{k:06}.ts", "op": "A", "imports": [f"d{(k + 1) % 50}/f{k + 1:06}.ts"] if k % 3 < 2 else []} for k in range(n)]
    h = snapshots.History(large=None)
    list(h.commit(0, 100, False, files))
    assert len(h.waiting) == 1 and len(h.vectors) == n and sum(x[0] ** 2 for x in h.vectors.values()) == pytest.approx(1)


def test_months_of_more_files_than_a_large_commit_have_nodes(spark, tmp_path):
    import duckdb

    from quarry.catalog import QUERIES

    # All orders of one nation, in twelve months, on 900 suppliers; each month changes all of them.
    con = duckdb.connect()
    put = lambda name, sql: con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    put("customer", "SELECT 0::BIGINT AS c_custkey, 3 AS c_nationkey")
    put("orders", "SELECT i::BIGINT AS o_orderkey, 0::BIGINT AS o_custkey, TIMESTAMP '2000-01-15' + to_months(i::INTEGER) AS o_orderdate FROM range(12) t(i)")
    put("lineitem", "SELECT o::BIGINT AS l_orderkey, s::BIGINT AS l_suppkey, s + o + 1 AS l_partkey, 'N' AS l_returnflag, 1 AS l_linenumber FROM range(12) t(o), range(900) u(s)")
    put("supplier", "SELECT i::BIGINT AS s_suppkey, (i % 25)::INTEGER AS s_nationkey FROM range(900) t(i)")
    got = QUERIES["r17_feature_nodes"](spark, str(tmp_path)).groupBy("seq").count().orderBy("seq").collect()
    assert [r["count"] for r in got] == [900, 900]


def test_nodes_apart_equal_those_of_the_rows(spark, tmp_path, commits, monkeypatch):
    monkeypatch.setattr(snapshots, "PIECE", 7)
    rows = rows_of(commits)
    want = {}
    for repo, cs in commits.items():
        h = snapshots.History(large=None)
        for seq, ts, subject, changes in cs:
            for x in h.commit(seq, ts, bool(subject and subject.lower() in ("fix style", "typo")), changes):
                want |= {(repo, x[0], n[0]): (x[9], x[11], *n[1:]) for n in x[-1]}
    got = []
    for k, (lo, hi) in enumerate(((0, 25), (25, 33), (30, 99))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], SCHEMA).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*")
        got += run(snapshots.node_stream(stream), "append", checkpoint=f"{tmp_path}/state").collect()
    labels = {(r.repo, r.seq): (r.collapse, r.tte) for r in got if r.id is None}
    found = {(r.repo, r.seq, r.id): (*labels[r.repo, r.seq], r.v2, r.v3, r.pr, r.churn) for r in got if r.id is not None and (r.repo, r.seq) in labels}
    assert found == want and len({k[:2] for k in found}) == len(labels) > 50
    h = snapshots.History(large=None, apart=True)
    for seq, ts, _, changes in commits["a"]:
        list(h.commit(seq, ts, False, changes))
    assert all(not w["nodes"] for w in h.waiting) and h._nodes["id"] == sorted(h.files)
