"""Token-id files of independent zstandard frames with a trailing seek table.

File layout (little-endian)::

    frame*                       one zstandard frame per document, content checksum on
    skippable frame 0x184D2A5E   seek table: per frame compressed size, size and the low
                                 32 bits of XXH64 of the content (three u32), then the
                                 footer: number of frames u32, descriptor u8 (0x80),
                                 magic 0x8F92EAB1
    skippable frame 0x184D2A5F   document ids (i64 each), in frame order

The first two parts are the public seekable format; the last part is a skippable frame of
its own *before* the seek table, so the table stays at the very end and plain zstandard
readers still decode the file.  A frame holds the ids of one document as unsigned 32-bit
integers.  A reader that wants a few documents reads the tail, then only their frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, new_path, read_file, texts_of
from quarry.llm.tokens import encoder

# Fixed values of the public seekable zstandard format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_IDS = 0x184D2A5F
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUM = 0x80

#: Documents whose frames are flushed together, and the level of compression.
LEVEL = 1
#: Compressed bytes after which a task starts another file, so a reader's file stays small.
FILE_BYTES = 32 << 20
#: Frames of a file at most (its seek table is read whole).
FILE_FRAMES = 200_000

#: Stands in a file for a missing document id.
NO_ID = -(1 << 63)


class FileWriter:
    """Builds one file in a stream opened by ``pyarrow.fs``."""

    def __init__(self, stream):
        self._out, self._zip = stream, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self._table, self._ids, self.size, self.tokens = [], [], 0, 0

    @property
    def frames(self) -> int:
        return len(self._ids)

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self._zip.compress(ids)
        self._out.write(frame)
        self._table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self._ids.append(doc_id)
        self.size += len(frame)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        own = np.array(self._ids, dtype="<i8").tobytes()
        table = np.array(self._table, dtype="<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", self.frames, HAS_CHECKSUM, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_IDS, len(own)) + own + struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self._out.close()


class FileReader:
    """Random access to a file.  ``read_at(offset, n)`` reads bytes from a file of ``size`` bytes."""

    def __init__(self, read_at, size: int):
        self._read_at = read_at
        if size < 9 + 16:
            raise ValueError("too short for a seek table")
        n, descriptor, magic = struct.unpack("<IBI", read_at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != HAS_CHECKSUM:
            raise ValueError("no seek table at the end")
        tail = 16 + 8 * n + 12 * n + 9
        raw = read_at(size - tail, tail)
        if struct.unpack("<II", raw[:8]) != (SKIPPABLE_IDS, 8 * n) or struct.unpack("<II", raw[8 + 8 * n : 16 + 8 * n]) != (SKIPPABLE_TABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.doc_ids = np.frombuffer(raw, "<i8", n, 8)
        self._table = np.frombuffer(raw, "<u4", 3 * n, 16 + 8 * n).reshape(n, 3)
        self._starts = np.concatenate([[0], np.cumsum(self._table[:, 0], dtype=np.int64)])
        self._unzip = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def tokens(self, k: int) -> int:
        return int(self._table[k, 1]) // 4

    def frame(self, k: int) -> bytes:
        """The ids of the k-th document, after both checksums hold."""
        size, length, check = map(int, self._table[k])
        ids = self._unzip.decompress(self._read_at(int(self._starts[k]), size), max_output_size=max(1, length))
        if len(ids) != length or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return ids

    def find(self, doc_id: int) -> int | None:
        """Its place among ascending document ids."""
        k = int(np.searchsorted(self.doc_ids, doc_id))
        return k if k < len(self) and self.doc_ids[k] == doc_id else None


def open_reader(uri: str) -> FileReader:
    """A reader over any store that ``pyarrow.fs`` opens; only the asked ranges are read."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)

    def read_at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    return FileReader(read_at, f.size())


def write_token_files(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files below ``uri``.

    Files ascend by document id: the table is range-partitioned and sorted by it, and file
    names carry the partition and a running number.  A file gets its final name only when
    it is whole; the name carries the task attempt and the returned manifest, which is
    itself a committed table, lists the files that count.  So a lost or repeated task
    leaves at most files that no manifest names.

    Returns the manifest: file, part, seq, frames, tokens.  A null text is empty, an empty
    text gives the end id alone, rows without an id come first and are read back without
    one, an empty table gives an empty manifest; rows that share an id stay separate frames.
    """
    tokenizer = read_file(tokenizer_path)
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        enc = encoder(tokenizer)
        writer, done = None, []

        def begin() -> None:
            nonlocal writer, name
            name = f"part-{context.partitionId():06d}-{len(done):05d}-{context.taskAttemptId()}.tokens"
            writer = FileWriter(store.open_output_stream(f"{root}/.{name}"))

        def finish() -> None:
            nonlocal writer
            writer.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            done.append((name, writer.frames, writer.tokens))
            writer = None

        name = ""
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    begin()
                writer.add(NO_ID if doc_id is None else doc_id, ids + end)
                if writer.size >= file_bytes or writer.frames >= FILE_FRAMES:
                    finish()
        if writer is not None:
            finish()
        part = context.partitionId()
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in done], "part": [part] * len(done), "seq": list(range(len(done))), "frames": [x[1] for x in done], "tokens": [x[2] for x in done]}, pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("frames", pa.int64()), ("tokens", pa.int64())]))

    spark = docs.sparkSession
    ranged = texts_of(docs, id_col, text_col).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")
    manifest = arrow_map(ranged, task, "file string, part int, seq int, frames long, tokens long")
    path = f"{uri}/_manifest"
    manifest.write.parquet(path)
    return spark.read.schema(manifest.schema).parquet(path)


def read_token_files(spark: SparkSession, uri: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files that the manifest names, in file order.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the
    ids as an array if ``with_ids``.
    Checksums are verified; a damaged file raises.
    """
    manifest = spark.read.schema("file string, part int, seq int, frames long, tokens long").parquet(f"{uri}/_manifest")
    # Prefix sums in two steps: over the files of a part, then over parts (one row each).
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    w = Window.partitionBy("part").orderBy("seq")
    starts = manifest.withColumn("inside", F.sum("tokens").over(w) - F.col("tokens")).join(parts, "part").select("file", (F.col("before") + F.col("inside")).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tokens").load(uri)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(starts, "file").select("before", "content")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(content.as_buffer())
                reader = FileReader(lambda at, n, view=view: view[at : at + n], len(view))
                k = 0
                while k < len(reader):
                    rows, size = [], 0
                    while k < len(reader) and size < 4 << 20:
                        ids = reader.frame(k)
                        rows.append((int(reader.doc_ids[k]), before, len(ids) // 4, ids))
                        before += len(ids) // 4
                        size += len(ids)
                        k += 1
                    cols = [pa.array([None if x[0] == NO_ID else x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([zlib.crc32(x[3]) for x in rows], pa.int64())]
                    if with_ids:
                        flat = pa.array(np.frombuffer(b"".join(x[3] for x in rows), "<u4").astype(np.int32))
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([x[2] for x in rows])]).astype(np.int32)), flat))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_map(files, task, schema, rows=1)


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Write all documents as token files and read them back.  doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    uri = new_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, uri, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, uri, with_ids=False)
