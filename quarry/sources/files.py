"""File sources and sinks: scans with admission rules, JSON lines, vector files, last-version backup."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ship import ship
from quarry.functions.text import basename, extension
from quarry.plans.stored import new_path
from quarry.registry import query
from quarry.sources.tables import table

# Suffixes that are never processed, and the largest size that is.
BLOCKED = [".min.js", ".min.css", ".map", ".wasm", ".bin", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar", ".lock", ".sqlite", ".db", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".exe", ".dll", ".so", ".dylib", ".ttf", ".woff", ".woff2", ".eot", ".pyc", ".pyo", ".class"]
MAX_BYTES = 500_000


def admission(path: Column, size: Column) -> Column:
    """Null if a file is processed, else the reason why not."""
    name = F.lower(basename(path))
    blocked = F.coalesce(*[F.when(name.endswith(s), F.lit(f"Blocked extension: {s}")) for s in BLOCKED])
    return F.coalesce(blocked, F.when(size > MAX_BYTES, F.concat(F.lit("File too large: "), size.cast("string"))))


def scan_folder(spark: SparkSession, folder: str, extensions: list[str], ignored: list[str] = ()) -> DataFrame:
    """path, length, text of the admitted files below a folder, byte order marks removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    keep = extension(F.col("path")).isin(extensions) & admission(F.col("path"), F.col("length")).isNull()
    for part in ignored:
        keep = keep & ~F.col("path").contains(f"/{part}/")
    return files.where(keep).select("path", "length", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines folder; malformed lines are dropped, the schema is never inferred."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail_json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The same as a stream: only new files are parsed."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def encode_vectors(rows: list[tuple[int, list[float]]]) -> bytes:
    """count u32, then per row id u32 and 32-bit floats."""
    return struct.pack("<I", len(rows)) + b"".join(struct.pack("<I", i) + np.asarray(v, "<f4").tobytes() for i, v in rows)


def decode_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """id, embedding of vector files; a file that is cut off ends with its last whole row."""
    ship(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                size = 4 + 4 * dim
                n = min(struct.unpack_from("<I", content)[0], (len(content) - 4) // size) if len(content) >= 4 else 0
                rows = np.frombuffer(content, np.dtype([("id", "<u4"), ("v", "<f4", (dim,))]), n, 4) if n else np.zeros(0, np.dtype([("id", "<u4"), ("v", "<f4", (dim,))]))
                values = pa.array(rows["v"].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"].astype(np.int64)), lists], ["id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, "id long, embedding array<float>")


def save_with_backup(df: DataFrame, path: str, version: int) -> str:
    """Write a version next to the earlier ones; the last complete one can be read again at any time."""
    target = f"{path}/v{version:08d}"
    df.write.mode("errorifexists").parquet(target)
    return target


@query("s4_admission", "WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a.ts' WHEN 1 THEN 'b.MIN.js' WHEN 2 THEN 'c.png' ELSE 'd.py' END AS name, n_chars * 100 AS size FROM documents) SELECT doc_id, CASE WHEN name = 'b.MIN.js' THEN 'Blocked extension: .min.js' WHEN name = 'c.png' THEN 'Blocked extension: .png' WHEN size > 500000 THEN 'File too large: ' || size END AS reason FROM f")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    f = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "a.ts").when(k == 1, "b.MIN.js").when(k == 2, "c.png").otherwise("d.py").alias("name"), (F.col("n_chars") * 100).alias("size"))
    return f.select("doc_id", admission(F.col("name"), F.col("size")).alias("reason"))


@query("s6_json_lines", "SELECT event_id, event_type AS tool_name, CAST(floor(value) AS BIGINT) AS input_tokens FROM events WHERE event_id % 7 <> 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool_name"), F.floor("value").cast("long").alias("input_tokens"))
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "tool_name", "input_tokens")))
    rows.select(line.alias("value")).write.text(path)
    return read_json_lines(spark, path, "event_id long, tool_name string, input_tokens long")


@query("s9_vector_files", "SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) + 0.0 AS total FROM embeddings")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vectors")
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        for k, batch in enumerate(batches):
            name = f"{root}/part-{context.partitionId()}-{k}.vec"
            with store.open_output_stream(name) as f:
                f.write(encode_vectors(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))))
            yield pa.RecordBatch.from_pydict({"file": [name]})

    table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(write, "file string").count()
    out = decode_vectors(spark, path, 64)
    return out.select("id", (F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))


@query("s11_skip_counters", "SELECT count(*) AS total, count(CASE WHEN text = '' THEN 1 END) AS empty, count(CASE WHEN n_chars < 200 THEN 1 END) AS short, count(CASE WHEN lang <> 'en' THEN 1 END) AS other_language FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.col("lang") != "en").alias("other_language"))


@query("s12_content_digest", "SELECT source, sha256(array_to_string(list_sort(list(CAST(doc_id AS VARCHAR) || ':' || n_chars)), ',')) AS digest FROM documents GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("digest"))


@query("s15_plaintext_fallback", "SELECT doc_id, '[file] ' || source || '/' || doc_id || ' (' || len(string_split(text, chr(10))) || ' lines)' AS shorthand FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("text", "\n", -1)).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[file] "), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(" ("), lines, F.lit(" lines)")).alias("shorthand"))


@query("k10_json_append", "SELECT count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "append")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").json(path)
    return spark.read.schema("event_id long, event_type string").json(path).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query("k13_versions", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "versions")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    first = save_with_backup(s, path, 1)
    save_with_backup(s.withColumn("s_acctbal", F.lit(0.0)), path, 2)
    return spark.read.parquet(first)


@query("c1_chunker", "WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, unnest(range(1, least(len(l), 2000) + 1)) AS chunk, unnest(l[1:2000]) AS raw FROM p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A text in lines, 2,000 chunks of it at most.
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n", -1), 1, 2000)).alias("p", "raw"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("chunk"), "raw")
