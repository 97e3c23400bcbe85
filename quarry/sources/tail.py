"""The tail of growing files as a stream: each whole line once, by byte offset.

An offset holds, for each file below a folder, the byte after its last whole line and how the file
begins.  A last line without its end is kept back until it has one.  A file that became shorter, or
begins otherwise, was replaced and is read from its beginning; one that is gone is forgotten.  Offsets lie
in the stream's checkpoint, so a restarted stream goes on where the last one stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry.plans.stored import new_path
from quarry.registry import query
from quarry.sources.tables import table

# Readers run in workers that may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes by which the beginning of a file is known.  Two files that begin alike are told apart by length only.
HEAD = 64
#: Bytes of a task, and bytes that are read at once.
TASK_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Lines of a batch at most.
LINES = 10_000
SCHEMA = "file string, at long, line string"


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from ``begin`` to before ``stop``; a line begins at ``begin`` if it is ``whole``."""

    file: str
    begin: int
    stop: int
    whole: bool


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self._seen: dict[str, tuple] = {}  # size, time and entry of files as they were last looked at

    def _store(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """For each file the byte after its last whole line, and its first bytes.  Files that did not change are not opened."""
        from pyarrow.fs import FileSelector, FileType

        store, root = self._store()
        files, seen = {}, {}
        for info in store.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)):
            name = info.path[len(root) :].lstrip("/")
            if info.type != FileType.File or any(p.startswith((".", "_")) for p in name.split("/")):
                continue
            known = self._seen.get(name)
            if known is None or known[:2] != (info.size, info.mtime_ns):
                with store.open_input_file(info.path) as f:
                    entry = [self._last_line_end(f, info.size), f.read_at(min(HEAD, info.size), 0).hex()]
                known = (info.size, info.mtime_ns, entry)
            seen[name] = known
            files[name] = known[2]
        self._seen = seen
        return {"files": files}

    @staticmethod
    def _last_line_end(f, size: int) -> int:
        while size > 0:
            begin = max(0, size - READ_BYTES)
            at = f.read_at(size - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, (stop, head) in sorted(end["files"].items()):
            begin, was = start["files"].get(name, (0, ""))
            if stop < begin or not head.startswith(was):
                begin = 0  # another file by the same name
            out += [Range(name, at, min(at + self.task_bytes, stop), at == begin) for at in range(begin, stop, self.task_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        with store.open_input_file(f"{root}/{partition.file}") as f:
            at = partition.begin
            if not partition.whole:
                at -= 1  # the line that begins here may begin just here
            f.seek(at)
            rest, skipping, places, lines = b"", not partition.whole, [], []
            while at < partition.stop and (block := f.read(READ_BYTES)):
                parts = (rest + block).split(b"\n")
                rest = parts.pop()
                for line in parts:
                    if at >= partition.stop:
                        break
                    if not skipping and line.strip():
                        places.append(at)
                        lines.append(line.decode("utf-8", "replace"))
                    skipping = False
                    at += len(line) + 1
                if len(lines) >= LINES:
                    yield self._batch(partition.file, places, lines)
                    places, lines = [], []
            if lines:
                yield self._batch(partition.file, places, lines)

    @staticmethod
    def _batch(file: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, at (the byte where it begins), line of the whole lines below ``folder``, blank ones left out.

    A folder that is not there yet is empty; what is no UTF-8 is replaced.
    """
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", folder).option("taskBytes", str(task_bytes)).load()


def tail_json(spark: SparkSession, folder: str, schema: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The JSON objects of a tail, by ``schema``; lines that are none are dropped."""
    read = F.from_json("line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return tail_lines(spark, folder, task_bytes).select(read.alias("r")).where(F.col("r").isNotNull() & F.col("r._broken").isNull()).select("r.*").drop("_broken")


def _grow(rows: DataFrame, folder: str, part: int) -> None:
    """Write the files' first halves and the beginning of the next line, or all that is missing.  A file has at most a thousand rows."""

    def write(group: pa.Table) -> pa.Table:
        from pyarrow.fs import FileSystem

        # By the line too: an identifier that repeats must not change the bytes from one writing to the next.
        group = group.sort_by([("event_id", "ascending"), ("line", "ascending")])
        lines = [(h, s.encode() + b"\n") for h, s in zip(group["half"].to_pylist(), group["line"].to_pylist(), strict=True)]
        first, second = (b"".join(s for h, s in lines if h == k) for k in (0, 1))
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{group['file'][0].as_py()}.jsonl") as f:
            # Both writings give the same bytes as far as the first goes, so a task that is repeated does no harm.
            f.write(first + second if part else first + second[:10])
        return group.select(["event_id"]).slice(0, 0)

    rows.groupBy("file").applyInArrow(write, "event_id long").write.format("noop").mode("overwrite").save()


@query("s6_growing_files", "SELECT CAST(event_id % 2 AS INTEGER) AS run, event_id, event_type AS tool_name FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run over a folder saw which line: the files grow between two runs, and a line is half written at the first."""
    path = new_path(spark, "tail")
    folder, out = f"{path}/files", f"{path}/out"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("file"), (F.col("event_id") % 2).alias("half"), F.to_json(F.struct("event_id", F.col("event_type").alias("tool_name"))).alias("line"))
    broken = rows.where("event_id % 1000 < 2").withColumn("line", F.lit('{"event_id": broken'))
    schema = "event_id long, tool_name string"
    for part in (0, 1):
        _grow(rows.unionByName(broken), folder, part)

        def put(batch: DataFrame, _: int, part: int = part) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/run={part}")

        tail_json(spark, folder, schema).writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(f"{schema}, run int").parquet(out).select("run", "event_id", "tool_name")
