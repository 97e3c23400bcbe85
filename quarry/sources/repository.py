"""The objects of a version-control repository as tables: commits, trees, blobs, and what changed between two trees.

Loose objects and packs are read by a data source, one partition for each range of objects, so neither
a pack nor the list of loose objects is read by one task.  Walks over trees and comparisons of
trees are joins.
"""

from __future__ import annotations

import bisect
import struct
import sys
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.ship import ship
from quarry.plans.stored import cut, new_path
from quarry.registry import query
from quarry.sources.tables import spread, table

# Readers run in workers that may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "oid string, kind string, size long, content binary"
# Kinds of objects in a pack.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_NAME = 6, 7
#: Objects of a task, and bytes of objects that a task keeps for those that are stored as changes of others.
TASK_OBJECTS, KEPT_BYTES = 20_000, 64 << 20


@dataclass
class Range(InputPartition):
    """Loose objects of folders ``first`` to before ``stop``, or a pack's objects by place in its order."""

    pack: str | None
    first: int
    stop: int


class Pack:
    """Objects of one pack by place in the order of their offsets."""

    def __init__(self, store, stem: str, data: bool = True):
        with store.open_input_file(f"{stem}.idx") as f:
            index = f.read()
        if index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{stem}.idx is no index of version 2")
        n = struct.unpack_from(">I", index, 8 + 255 * 4)[0]
        self.names = [index[at : at + 20] for at in range(1032, 1032 + 20 * n, 20)]
        small = struct.unpack_from(f">{n}I", index, 1032 + 24 * n)
        large = 1032 + 28 * n
        offsets = [x if x < 1 << 31 else struct.unpack_from(">Q", index, large + 8 * (x & 0x7FFFFFFF))[0] for x in small]
        self.order = sorted(range(n), key=offsets.__getitem__)
        self.offsets = [offsets[k] for k in self.order]
        self.offset_of = offsets
        self.file = store.open_input_file(f"{stem}.pack") if data else None
        self.end = self.file.size() - 20 if data else 0
        self.kept: OrderedDict[int, tuple[int, bytes]] = OrderedDict()
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.offsets)

    def name(self, place: int) -> str:
        return self.names[self.order[place]].hex()

    def read(self, place: int) -> tuple[str, bytes]:
        """Kind and content.  Changes of changes are followed to their base without recursion."""
        chain, at = [], self.offsets[place]
        while True:
            if at in self.kept:
                kind, content = self.kept[at]
                self.kept.move_to_end(at)
                break
            kind, base, data = self._entry(at)
            if base is None:
                content = data
                self._keep(at, kind, content)
                break
            chain.append((at, data))
            at = base
        for at, change in reversed(chain):
            content = patched(content, change)
            self._keep(at, kind, content)
        return KINDS[kind], content

    def _keep(self, at: int, kind: int, content: bytes) -> None:
        self.kept[at] = kind, content
        self.bytes += len(content)
        while self.bytes > KEPT_BYTES and len(self.kept) > 1:
            self.bytes -= len(self.kept.popitem(last=False)[1][1])

    def _entry(self, at: int) -> tuple[int, int | None, bytes]:
        """Kind, offset of the base or none, and data of the entry at an offset."""
        k = bisect.bisect_right(self.offsets, at)
        stop = self.offsets[k] if k < len(self.offsets) else self.end
        raw = self.file.read_at(stop - at, at)
        kind, place = raw[0] >> 4 & 7, 1
        while raw[place - 1] & 0x80:
            place += 1
        base = None
        if kind == BY_OFFSET:
            back = raw[place] & 0x7F
            while raw[place] & 0x80:
                place += 1
                back = (back + 1) << 7 | raw[place] & 0x7F
            place += 1
            base = at - back
        elif kind == BY_NAME:
            base = self.offset_of[bisect.bisect_left(self.names, raw[place : place + 20])]
            place += 20
        return kind, base, zlib.decompress(raw[place:])


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 0x80:
            return value, at


def patched(base: bytes, change: bytes) -> bytes:
    """The object that a change makes of its base: copied pieces and new ones."""
    _, at = _number(change, 0)
    size, at = _number(change, at)
    out = []
    while at < len(change):
        op, at = change[at], at + 1
        if op & 0x80:
            values = []
            for bits in (range(4), range(4, 7)):
                value = 0
                for k, bit in enumerate(bits):
                    if op >> bit & 1:
                        value |= change[at] << 8 * k
                        at += 1
                values.append(value)
            out.append(base[values[0] : values[0] + (values[1] or 0x10000)])
        else:
            out.append(change[at : at + op])
            at += op
    made = b"".join(out)
    if len(made) != size:
        raise ValueError("a change does not fit its base")
    return made


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.task_objects = int(options.get("taskObjects", TASK_OBJECTS))

    def _store(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.folder)

    def partitions(self) -> list[Range]:
        from pyarrow.fs import FileSelector

        store, root = self._store()
        packs = [i.path for i in store.get_file_info(FileSelector(f"{root}/objects/pack", allow_not_found=True)) if i.path.endswith(".idx")]
        out = [Range(None, k, k + 16) for k in range(0, 256, 16)]
        for path in sorted(packs):
            n = len(Pack(store, path[:-4], data=False))
            out += [Range(path[:-4], k, min(k + self.task_objects, n)) for k in range(0, n, self.task_objects)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, root = self._store()
        if partition.pack:
            pack = Pack(store, partition.pack)
            for place in range(partition.first, partition.stop):
                kind, content = pack.read(place)
                yield pack.name(place), kind, len(content), content
            return
        from pyarrow.fs import FileSelector

        for k in range(partition.first, partition.stop):
            for info in store.get_file_info(FileSelector(f"{root}/objects/{k:02x}", allow_not_found=True)):
                if len(info.base_name) == 38:
                    with store.open_input_file(info.path) as f:
                        head, content = zlib.decompress(f.read()).split(b"\x00", 1)
                    yield f"{k:02x}{info.base_name}", head.split(b" ")[0].decode(), len(content), content


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)


def objects(spark: SparkSession, folder: str, task_objects: int = TASK_OBJECTS) -> DataFrame:
    """oid, kind, size, content of the objects of the repository below ``folder``; one that lies loose and in a pack comes twice."""
    spark.dataSource.register(Objects)
    return spark.read.format("repository_objects").option("path", folder).option("taskObjects", str(task_objects)).load()


def commits(found: DataFrame) -> DataFrame:
    """oid, tree, parents, author, epoch, subject of the commits among objects."""
    text = F.decode("content", "utf-8")
    head = F.substring_index(text, "\n\n", 1)
    one = lambda p, k=1: F.regexp_extract(head, p, k)
    return found.where("kind = 'commit'").select("oid", one(r"^tree ([0-9a-f]{40})").alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$")).alias("parents"), one(r"(?m)^author (.*) <").alias("author"), one(r"(?m)^committer .*> (\d+) [+-]\d+$").cast("long").alias("epoch"), F.regexp_extract(text, r"\n\n([^\n]*)", 1).alias("subject"))


def tree_entries(found: DataFrame) -> DataFrame:
    """tree, mode, name, oid: the entries of the trees among objects."""
    ship(found.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, content in zip(batch.column("oid").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = 0
                while at < len(content):
                    blank, end = content.index(b" ", at), content.index(b"\x00", at)
                    rows.append((tree, content[at:blank].decode(), content[blank + 1 : end].decode("utf-8", "replace"), content[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((),) * 4)], ["tree", "mode", "name", "oid"])

    return found.where("kind = 'tree'").select("oid", "content").mapInArrow(task, "tree string, mode string, name string, oid string")


def list_trees(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """root, path, mode, oid of all files below the trees in ``roots`` (root); one join a level of folders.

    ``entries`` is read once a level, so it should be stored.
    """
    level = roots.select("root", F.col("root").alias("tree"), F.lit("").alias("at")).distinct()
    files = None
    while True:
        inside = cut(level.join(entries, "tree").select("root", F.concat("at", "name").alias("path"), "mode", "oid"))
        found = inside.where("mode <> '40000'")
        files = found if files is None else files.unionByName(found)
        level = inside.where("mode = '40000'").select("root", F.col("oid").alias("tree"), F.concat("path", F.lit("/")).alias("at"))
        if level.isEmpty():
            return files


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """status (A, M, D), path, old_blob, new_blob between two listings (path, mode, oid)."""
    met = before.select("path", F.col("mode").alias("old_mode"), F.col("oid").alias("old_blob")).join(after.select("path", F.col("mode").alias("new_mode"), F.col("oid").alias("new_blob")), "path", "full")
    status = F.when(F.col("old_blob").isNull(), "A").when(F.col("new_blob").isNull(), "D").otherwise("M")
    same = F.col("old_blob").eqNullSafe(F.col("new_blob")) & F.col("old_mode").eqNullSafe(F.col("new_mode"))
    return met.where(~same).select(status.alias("status"), "path", "old_blob", "new_blob")


def write_loose(rows: DataFrame, folder: str) -> None:
    """Write (oid, object) as loose objects; a task that is repeated writes the same files again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        for batch in batches:
            for oid, raw in zip(batch.column("oid").to_pylist(), batch.column("object").to_pylist(), strict=True):
                store.create_dir(f"{root}/objects/{oid[:2]}", recursive=True)
                with store.open_output_stream(f"{root}/objects/{oid[:2]}/{oid[2:]}") as f:
                    f.write(zlib.compress(raw))
            yield batch.slice(0, 0)

    ship(rows.sparkSession)
    spread(rows.select("oid", "object")).mapInArrow(task, "oid string, object binary").write.format("noop").mode("overwrite").save()


def _object(kind: str, content) -> list:
    raw = F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")), content)
    return [F.sha1(raw).alias("oid"), raw.alias("object")]


def _repository(spark: SparkSession, sf_dir: str, name: str, blobs: DataFrame) -> tuple[str, str]:
    """Write (folder, file, text) as a commit; returns the place of the repository and the commit's name."""
    folder = new_path(spark, name)
    folder = folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"
    blobs = cut(blobs.select("folder", "file", *_object("blob", F.col("text").cast("binary"))))
    entry = lambda mode, file, oid: F.concat(F.concat(F.lit(f"{mode} "), file).cast("binary"), F.unhex(F.lit("00")), F.unhex(oid))
    joined = lambda c: F.aggregate(F.transform(F.array_sort(c), lambda x: x["e"]), F.lit(b""), lambda a, x: F.concat(a, x))
    trees = blobs.groupBy("folder").agg(joined(F.collect_list(F.struct("file", entry("100644", F.col("file"), F.col("oid")).alias("e")))).alias("content"))
    trees = cut(trees.select("folder", *_object("tree", F.col("content"))))
    root = trees.agg(joined(F.collect_list(F.struct(F.concat("folder", F.lit("/")).alias("folder"), entry("40000", F.col("folder"), F.col("oid")).alias("e")))).alias("content"))
    root = cut(root.select(*_object("tree", F.col("content"))))
    commit = root.select(F.concat(F.lit("tree "), "oid", F.lit("\nauthor A <a@b.c> 5 +0000\ncommitter A <a@b.c> 7 +0000\n\nAll suppliers\n")).cast("binary").alias("content")).select(*_object("commit", F.col("content")))
    for rows in (blobs, trees, root, commit):
        write_loose(rows, folder)
    return folder, commit.first()["oid"]


@query("s10_tree_and_blobs", "WITH b AS (SELECT 'n' || s_nationkey AS folder, 's' || s_suppkey || '.txt' AS file, s_name || chr(10) || s_suppkey || 'é' AS text FROM supplier) SELECT folder || '/' || file AS path, sha1('blob ' || strlen(text) || chr(0) || text) AS oid, 7 AS epoch, 'All suppliers' AS subject, text FROM b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files of a repository, read back from its objects: commit, trees, blobs."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("folder"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("file"), F.concat("s_name", F.lit("\n"), F.col("s_suppkey").cast("string"), F.lit("é")).alias("text"))
    folder, name = _repository(spark, sf_dir, "repository", rows)
    found = cut(objects(spark, folder))
    commit = commits(found).where(F.col("oid") == name).select(F.col("tree").alias("root"), "epoch", "subject")
    files = list_trees(commit, cut(tree_entries(found))).join(commit, "root")
    return files.join(found.where("kind = 'blob'").select("oid", F.decode("content", "utf-8").alias("text")), "oid").select("path", "oid", F.col("epoch").cast("int").alias("epoch"), "subject", "text")


@query("s10_tree_changes", """WITH s AS (SELECT s_suppkey, 'n' || s_nationkey || '/s' || s_suppkey || '.txt' AS path, s_name || chr(10) AS old, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '!' ELSE s_name || chr(10) END AS new FROM supplier),
  b AS (SELECT path, sha1('blob ' || strlen(old) || chr(0) || old) AS oid FROM s WHERE s_suppkey % 7 <> 0), a AS (SELECT path, sha1('blob ' || strlen(new) || chr(0) || new) AS oid FROM s WHERE s_suppkey % 11 <> 0)
  SELECT CASE WHEN b.oid IS NULL THEN 'A' WHEN a.oid IS NULL THEN 'D' ELSE 'M' END AS status, path, b.oid AS old_blob, a.oid AS new_blob FROM b FULL JOIN a USING (path) WHERE b.oid IS DISTINCT FROM a.oid""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two commits of one repository differ in, from their trees."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("folder"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("file"))
    plain = F.concat("s_name", F.lit("\n"))
    sides = [s.where("s_suppkey % 7 <> 0").withColumn("text", plain), s.where("s_suppkey % 11 <> 0").withColumn("text", F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit("!"))).otherwise(plain))]
    listed = []
    for k, rows in enumerate(sides):
        folder, name = _repository(spark, sf_dir, f"repository-{k}", rows)
        found = cut(objects(spark, folder))
        listed.append(list_trees(commits(found).where(F.col("oid") == name).select(F.col("tree").alias("root")), cut(tree_entries(found))))
    return tree_changes(*listed)
