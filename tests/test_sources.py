"""Tails of growing files, folded changes and repository objects, against what a plain reader sees."""

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.sources import repository, tail
from quarry.streaming import changes
from quarry.streaming.events import run


def append(path, data, mode="ab"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def drain(spark, folder, state, task_bytes=tail.TASK_BYTES):
    """(file, at, line) that one run of the tail sees."""
    out = []

    def put(batch, _):
        out.extend(tuple(r) for r in batch.collect())

    tail.tail_lines(spark, f"file://{folder}", task_bytes).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return sorted(out)


def test_a_tail_sees_each_whole_line_once(spark, tmp_path):
    folder, state = f"{tmp_path}/logs", f"{tmp_path}/state"
    assert drain(spark, folder, state) == []
    append(f"{folder}/a.jsonl", b"one\ntwo\nhal")
    append(f"{folder}/deep/b.jsonl", "é\n\n  \nx\n".encode())
    append(f"{folder}/_tmp", b"no\n")
    assert drain(spark, folder, state) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("deep/b.jsonl", 0, "é"), ("deep/b.jsonl", 7, "x")]
    assert drain(spark, folder, state) == []
    append(f"{folder}/a.jsonl", b"f\nthree\r\n\xff\n")
    append(f"{folder}/c.jsonl", b"no end")
    assert drain(spark, folder, state) == [("a.jsonl", 8, "half"), ("a.jsonl", 13, "three\r"), ("a.jsonl", 20, "�")]
    append(f"{folder}/c.jsonl", b"\n")
    assert drain(spark, folder, state) == [("c.jsonl", 0, "no end")]


def test_a_tail_reads_replaced_files_anew(spark, tmp_path):
    folder, state = f"{tmp_path}/logs", f"{tmp_path}/state"
    append(f"{folder}/short", b"1\n2\n3\n")
    append(f"{folder}/longer", b"1\n2\n")
    append(f"{folder}/gone", b"1\n")
    assert len(drain(spark, folder, state)) == 6
    append(f"{folder}/short", b"1\n4\n", "wb")  # shorter
    append(f"{folder}/longer", b"5\n6\n7\n", "wb")  # longer, and begins otherwise
    os.remove(f"{folder}/gone")
    assert [(f, x) for f, _, x in drain(spark, folder, state)] == [("longer", "5"), ("longer", "6"), ("longer", "7"), ("short", "1"), ("short", "4")]
    append(f"{folder}/gone", b"1\n")  # it comes back
    assert drain(spark, folder, state) == [("gone", 0, "1")]


@pytest.mark.parametrize("task_bytes", [1, 7, 64, 1000])
def test_a_tail_in_pieces_equals_the_whole(spark, tmp_path, task_bytes):
    rng = random.Random(task_bytes)
    lines = ["x" * rng.randrange(30) for _ in range(60)]
    append(f"{tmp_path}/logs/a", ("\n".join(lines) + "\n").encode())
    got = drain(spark, f"{tmp_path}/logs", f"{tmp_path}/state", task_bytes)
    assert [x for _, _, x in got] == [x for x in lines if x] and [a for _, a, _ in got] == sorted({a for _, a, _ in got})


def test_json_tails_drop_broken_lines(spark, tmp_path):
    append(f"{tmp_path}/logs/a", b'{"n": 1}\n{"n": \nnull\n[1]\n{"n": 2, "m": 3}\n{"n": "x"}\n')
    rows = tail.tail_json(spark, f"file://{tmp_path}/logs", "n long")
    assert sorted(r.n for r in run(rows, "append").collect()) == [1, 2]


def folded(rows, quiet):
    """Each path in order of time: its changes, and whether each was another's."""
    out = []
    for path in sorted({r[0] for r in rows}):
        waiting, ticket = None, None
        for r in [*sorted((r for r in rows if r[0] == path), key=lambda r: (r[4], r[2])), (path, "end", 0, None, float("inf"))]:
            if waiting and r[4] > waiting[4] + quiet:
                out.append((path, waiting[2], waiting[1], waiting[3], waiting[1] == "unlink" or ticket is None or ticket[0] != waiting[3]))
                waiting = ticket = None
            if r[1] == "ticket":
                ticket = (r[3],)
            elif r[1] != "end":
                waiting = r
    return sorted(map(str, out))


def test_changes_fold_whatever_the_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], 1_700_000_000_000
    for seq in range(300):
        at += rng.choice([1, 50, 400, 3000])
        rows.append((rng.choice("abcd"), rng.choice(["add", "change", "change", "ticket", "unlink"]), seq, rng.choice(["h1", "h2"]), at))
    schema = "path string, op string, seq long, hash string, ts timestamp"
    typed = lambda part: spark.createDataFrame([(*r[:4], r[4]) for r in part], "path string, op string, seq long, hash string, at long").select("path", "op", "seq", "hash", F.timestamp_millis("at").alias("ts"))
    got = []
    with changes.large_state(spark):
        for k, part in enumerate([rows[:90], rows[90:91], rows[91:], [("~", "change", -1, "", at + 10**9), (None, "change", -2, "", at)]]):
            typed(part).write.parquet(f"{tmp_path}/in/part={k}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*")
            got += run(changes.fold_changes(stream, 1000), "append", checkpoint=f"{tmp_path}/state").collect()
    assert sorted(str(tuple(r)) for r in got) == folded(rows, 1000)
    assert {r.external for r in got} == {True, False}


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_objects_of_a_repository(spark, tmp_path):
    home = f"{tmp_path}/repo"
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d", "HOME": str(tmp_path)}
    git = lambda *a: subprocess.run(["git", "-C", home, *a], check=True, capture_output=True, env=env).stdout.decode()
    os.makedirs(home)
    git("init", "-q")
    rng = random.Random(5)
    text = [f"line {rng.random()}" for _ in range(3000)]
    names = []
    for k in range(6):  # versions of a long file become changes of each other in a pack
        text[rng.randrange(3000)] = f"changed {k}"
        append(f"{home}/src/deep/long.txt", "\n".join(text).encode(), "wb")
        append(f"{home}/src/f{k}.bin", bytes(range(256)) * k, "wb")
        append(f"{home}/é {k}", b"", "wb")
        if k == 4:
            os.remove(f"{home}/src/f1.bin")
            os.chmod(f"{home}/src/f2.bin", 0o755)
        git("add", "-A")
        git("commit", "-q", "-m", f"Commit {k} | bar\n\nbody")
        names.append(git("rev-parse", "HEAD").strip())
        if k == 3:
            git("gc", "-q", "--aggressive")
    found = repository.objects(spark, f"file://{home}/.git", task_objects=7).cache()
    listed = {tuple(x.split()) for x in git("cat-file", "--batch-all-objects", "--batch-check").splitlines()}
    assert {(r.oid, r.kind, str(r["size"])) for r in found.collect()} == listed
    from hashlib import sha1

    assert all(sha1(f"{r.kind} {r['size']}".encode() + b"\0" + r.content).hexdigest() == r.oid for r in found.collect())
    log = repository.commits(found).collect()
    assert {(r.oid, r.subject, r.author) for r in log} == {(n, f"Commit {k} | bar", "A B") for k, n in enumerate(names)}
    assert {r.oid: r.parents for r in log} == {n: names[k - 1 : k] if k else [] for k, n in enumerate(names)}
    entries, trees = repository.tree_entries(found).cache(), {r.oid: r.tree for r in log}
    sides = {}
    for n in (names[3], names[5]):
        root = spark.createDataFrame([(trees[n],)], "root string")
        sides[n] = repository.list_trees(root, entries).cache()
        want = {(m, o, p) for m, _, o, p in (x.replace("\t", " ", 1).split(" ", 3) for x in git("ls-tree", "-r", "-z", n).split("\0") if x)}
        assert {(r.mode, r.oid, r.path) for r in sides[n].collect()} == want
    raw = git("diff-tree", "-r", "-z", "--no-renames", names[3], names[5]).split("\0")
    want = {(x.split(" ")[4], x.split(" ")[2], x.split(" ")[3], p) for x, p in zip(raw[::2], raw[1::2], strict=False)}
    got = {(r.status, r.old_blob or "0" * 40, r.new_blob or "0" * 40, r.path) for r in repository.tree_changes(*sides.values()).collect()}
    assert got == want and len(want) >= 5


def test_an_empty_repository_has_no_objects(spark, tmp_path):
    found = repository.objects(spark, f"file://{tmp_path}/none")
    assert found.count() == 0 and repository.commits(found).count() == 0 and repository.tree_entries(found).count() == 0
