"""Bulk-synchronous best-fit packing of token pieces into sequences of a fixed length.

Lengths are integers from 1 to the sequence length, so the range-sorted pieces and the
range-sorted gaps are both sorted tables of *runs*: a run of pieces is all pieces of one
length, known by rank; a run of gaps is an interval of sequences with one free length.  The
runs take part in supersteps until no piece is left:

1. **Sort.**  The gaps and the longest pieces left (those longer than half of the longest)
   are sorted together by size, gaps before pieces of the same size.
2. **Sweep.**  Longest first, each run of pieces sweeps the gaps from its successor, the smallest
   that holds it, upwards.  Prefix sums tell how many gaps lie open at every place of the
   order; a piece takes the gap that was opened last at the depth which it closes, as
   brackets match.
3. **Conflicts.**  Pieces of a run, and runs that want the same gaps, are settled by rank: by
   their place in the order and then within the run.  Who gets none waits for the next superstep.
4. **Update.**  Gaps that took pieces are cut; where a piece finds no gap at all,
   sequences are opened.

A sequence takes as many pieces of one length at once as its run's successor holds, so the number of
supersteps grows with the logarithm of the length and not with the documents.  All
tables of a superstep have some thousand rows, whatever the number of
documents, so each is held in one partition, its windows shuffle nothing, and the driver hands it from
one superstep to the next.  Only the first and the last step touch pieces:

* executors encode texts and cut them; each piece is written with its rank among the pieces
  of its length in its task (no shuffle); pieces per (length, task) are counted and
  prefix-summed, which gives the rank in the whole run,
* the runs of the result are broadcast (a bounded table) and joined on length and a bucket of ranks.
"""

from __future__ import annotations

import contextlib
import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, materialize, read_file, texts_of
from quarry.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


#: A row of what a superstep leaves.  ``gap``: sequences from ``lo`` to before ``hi`` have ``size`` free.  ``placed``:
#: pieces of length ``size`` with ranks from ``lo`` to before ``hi`` lie in sequences from ``sequence`` on,
#: ``per`` in each, the first at ``offset``.
RUNS = "kind string, size long, lo long, hi long, per long, sequence long, offset long"


class Placed(NamedTuple):
    """Pieces of one length with ranks from ``lo`` to before ``hi``: ``per`` in each sequence from ``sequence`` on, the first at ``offset``."""

    size: int
    lo: int
    hi: int
    per: int
    sequence: int
    offset: int


#: Pieces that are left: their length and ranks.
LEFT = "size long, lo long, hi long"


def _run(kind: str, **columns: str) -> str:
    names = [c.split()[0] for c in RUNS.split(", ")][1:]
    values = ", ".join(f"'{n}', cast({columns.get(n, 'null')} as bigint)" for n in names)
    return f"named_struct('kind', '{kind}', {values})"


def _events(gaps: DataFrame, pieces: DataFrame) -> DataFrame:
    """Sorted gaps and pieces of a superstep (is_piece): place, size, lo and hi of pieces, how many fit a gap, and the depths they open or close."""
    order = Window.orderBy(F.desc("size"), "is_piece")
    gaps = gaps.groupBy("size").agg(F.sum(F.expr("hi - lo")).alias("hi")).select("size", F.lit(False).alias("is_piece"), F.lit(0).cast("long").alias("lo"), "hi")
    both = gaps.unionByName(pieces.select("size", F.lit(True).alias("is_piece"), "lo", "hi"))
    successor = F.last(F.when(~F.col("is_piece"), F.col("size")), ignorenulls=True).over(order)
    both = both.withColumn("per", F.when(F.col("is_piece"), F.floor(successor / F.col("size"))).otherwise(1)).where("per is not null")
    # Open gaps after each row: a prefix sum that does not fall below none.
    units = F.expr("if(is_piece, -ceil((hi - lo) / per), hi - lo)").cast("long")
    both = both.withColumn("total", F.sum(units).over(order)).withColumn("after", F.col("total") - F.least(F.min("total").over(order), F.lit(0)))
    both = both.withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0))).withColumn("place", F.row_number().over(order))
    return both.select("place", "size", "is_piece", "lo", "hi", "per", F.least("before", "after").alias("bottom"), F.greatest("before", "after").alias("top")).where("bottom < top")


def _matches(events: DataFrame) -> DataFrame:
    """Rows of one depth range: the pieces (is_piece, or gaps that stay open), the gaps' size, the first units of either, and how many."""
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cuts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("bottom", "top")).over(everything))))
    reach = F.expr("slice(cuts, array_position(cuts, bottom), array_position(cuts, top) - array_position(cuts, bottom) + 1)")
    ranges = F.expr("transform(slice(cuts, 1, size(cuts) - 1), (c, i) -> struct(c as from_, cuts[i + 1] as to_))")
    parts = events.withColumn("cuts", cuts).withColumn("cuts", reach).withColumn("part", F.explode(ranges)).drop("cuts")
    # At one depth gaps and pieces take turns.
    turns = Window.partitionBy("part.from_").orderBy("place")
    parts = parts.withColumn("gap", F.lag(F.struct("size", "bottom")).over(turns)).withColumn("taken", F.lead("place").over(turns).isNotNull()).where("is_piece or not taken")
    return parts.select("size", "is_piece", "lo", "hi", "per", F.expr("top - part.to_").alias("unit"), F.expr("if(is_piece, gap.size, size)").alias("gap_size"), F.expr("part.from_ - if(is_piece, gap.bottom, bottom)").alias("gap"), F.expr("part.to_ - part.from_").alias("n"))


def superstep(gaps: DataFrame, pieces: DataFrame, max_len: int) -> DataFrame:
    """``RUNS`` that are there after ``pieces`` (``LEFT``) swept ``gaps`` (size, lo, hi)."""
    runs = gaps.withColumn("cum", F.sum(F.expr("hi - lo")).over(Window.partitionBy("size").orderBy("lo")) - F.expr("hi - lo"))
    runs = runs.select(F.col("size").alias("gap_size"), "cum", F.col("lo").alias("begin"), F.expr("hi - lo").alias("width"))
    both = _matches(_events(gaps, pieces)).join(runs, "gap_size").withColumn("a", F.greatest("gap", "cum")).withColumn("b", F.expr("least(gap + n, cum + width)")).where("a < b")
    both = both.withColumn("at", F.expr("begin + a - cum")).withColumn("r0", F.expr("lo + (unit + a - gap) * per")).withColumn("r1", F.expr("least(hi, lo + (unit + b - gap) * per)"))
    placed = _run("placed", size="size", lo="r0", hi="r1", per="per", sequence="at", offset=f"{max_len} - gap_size")
    full = _run("gap", size="gap_size - size * per", lo="at", hi="at + (r1 - r0) div per")
    part = _run("gap", size="gap_size - size * ((r1 - r0) % per)", lo="at + (r1 - r0) div per", hi="at + (r1 - r0) div per + if((r1 - r0) % per > 0, 1, 0)")
    still = _run("gap", size="gap_size", lo="at", hi="at + b - a")
    return both.select(F.explode(F.expr(f"if(is_piece, array({placed}, {full}, {part}), array({still}))")).alias("run")).select("run.*").where("size > 0 and lo < hi")


@contextlib.contextmanager
def _tiny(spark: SparkSession) -> Iterator[None]:
    """For tables of a few thousand rows code is not worth generating, nor plans worth changing as they run."""
    keys = ("spark.sql.codegen.wholeStage", "spark.sql.adaptive.enabled")
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "false")
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table in one partition."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)).coalesce(1)


def _joined(gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of gaps (size, lo, hi); neighbours of one size become one."""
    out: list[tuple[int, int, int]] = []
    for size, lo, hi in sorted(gaps):
        if out and out[-1][0] == size and out[-1][2] == lo:
            out[-1] = (size, out[-1][1], hi)
        else:
            out.append((size, lo, hi))
    return out


def _joined_places(runs: list[Placed]) -> list[Placed]:
    """Runs of places by length and rank; one that goes on where the last ends, in the next sequences, becomes part of it."""
    out: list[Placed] = []
    for r in sorted(runs):
        last = out[-1] if out else None
        if last and (last.size, last.hi, last.per, last.offset) == (r.size, r.lo, r.per, r.offset) and (last.hi - last.lo) % last.per == 0 and last.sequence + (last.hi - last.lo) // last.per == r.sequence:
            out[-1] = last._replace(hi=r.hi)
        else:
            out.append(r)
    return out


def plan(counts: DataFrame, max_len: int) -> list[Placed]:
    """Where the pieces lie, by length and rank.  ``counts``: length, n of all pieces.

    A superstep is one job over a table of runs; what it leaves comes back as a few
    thousand rows at most, whatever the number of pieces, in which neighbouring runs are joined for the next one.
    """
    spark = counts.sparkSession
    left = {r["length"]: (0, r["n"]) for r in counts.collect()}
    if any(not 0 < x <= max_len for x in left):
        raise ValueError(f"pieces must have 1 to {max_len} tokens")
    gaps: list[tuple[int, int, int]] = []
    placed: list[Placed] = []
    opened = 0
    with _tiny(spark):
        while left:
            most, widest = max(left), max((size for size, _, _ in gaps), default=0)
            own = sorted((x, lo, hi) for x, (lo, hi) in left.items() if x * 2 > most)
            alone = [(hi - lo, max_len // x) for x, lo, hi in own if x > widest]
            if alone:
                # So many sequences hold them if each is filled with pieces of one length.
                n = math.ceil(sum(Fraction(c, fit) for c, fit in alone))
                gaps.append((max_len, opened, opened + n))
                opened += n
            # Gaps that are too small for any of these pieces wait.
            least = own[0][0]
            waiting, open_ = ([g for g in gaps if (g[0] >= least) == fits] for fits in (False, True))
            runs = superstep(_local(spark, open_, "size long, lo long, hi long"), _local(spark, own, LEFT), max_len).collect()
            gaps = _joined(waiting + [(r["size"], r["lo"], r["hi"]) for r in runs if r["kind"] == "gap"])
            for r in runs:
                if r["kind"] == "placed":
                    placed.append(Placed(r["size"], r["lo"], r["hi"], r["per"], r["sequence"], r["offset"]))
                    left[r["size"]] = (max(left[r["size"]][0], r["hi"]), left[r["size"]][1])
            left = {x: (lo, hi) for x, (lo, hi) in left.items() if lo < hi}
    return _joined_places(placed)


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for the first."""
    if n <= max_len:
        return [(0, n)]
    head = n % max_len
    return ([(0, head)] if head else []) + [(at, max_len) for at in range(head, n, max_len)]


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached_chunks: int | None = None) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task."""
    tokenizer = read_file(tokenizer_path)
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, me = encoder(tokenizer, cached_chunks), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, (start, n) in enumerate(cut(len(ids) // 4, max_len)):
                    own = ids[4 * start : 4 * (start + n)]
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    for col, x in zip(cols, (doc_id, k, start, n, zlib.crc32(own), me, rank, own), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names if with_ids else names[:-1])

    return arrow_map(texts_of(docs, id_col, text_col), task, PIECES + ", ids binary" * with_ids)


def pack(pieces: DataFrame, max_len: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a *stored* table of pieces.

    The table must be stored, since ranks refer to the tasks that wrote it.  Ties of length go
    by rank; other columns come through; an empty table gives none.
    """
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("task")
    before = per_task.select("length", "task", (F.sum("n").over(w) - F.col("n")).alias("before"))
    placed = plan(pieces.groupBy("length").agg(F.count("*").alias("n")), max_len)
    # A row meets the runs of its length in its bucket of ranks: one or two, as there are as many buckets as runs.
    runs_of, most = Counter(r.size for r in placed), Counter()
    for r in placed:
        most[r.size] = max(most[r.size], r.hi)
    width = {x: -(-most[x] // runs_of[x]) for x in most}
    buckets = [(r.size, b, r.lo, r.hi, r.per, r.sequence, r.offset) for r in placed for b in range(r.lo // width[r.size], (r.hi - 1) // width[r.size] + 1)]
    table = F.broadcast(_local(spark, buckets, "length long, _bucket long, lo long, hi long, per long, sequence long, from long"))
    widths = F.broadcast(_local(spark, sorted(width.items()), "length long, _width long"))  # a row a length
    ranked = pieces.join(before.join(widths, "length"), ["length", "task"]).withColumn("_rank", F.col("before") + F.col("rank"))
    ranked = ranked.withColumn("_bucket", F.expr("_rank div _width"))
    out = ranked.join(table, ["length", "_bucket"]).where((F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).withColumn("_at", F.col("_rank") - F.col("lo"))
    out = out.withColumn("sequence_id", F.expr("sequence + _at div per")).withColumn("offset", F.expr("`from` + (_at % per) * length"))
    return out.drop("_rank", "_at", "_bucket", "_width", "before", "rank", "task", "lo", "hi", "per", "sequence", "from")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached_chunks: int | None = None) -> DataFrame:
    """Pack whole documents into sequences of at most ``max_len`` tokens.

    Only documents longer than that are cut, into full pieces after a first piece that may
    be shorter.  Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and the ids as bytes if ``with_ids``.  ``cached_chunks`` bounds the memory of a
    worker (400 bytes each), not the result.  A null text is empty; an empty text is
    the end id alone; repeated or null ids stay separate rows; an empty table gives none.
    """
    pieces = materialize(encode_pieces(docs, tokenizer_path, end_id, max_len, id_col, text_col, with_ids, cached_chunks), "pieces")
    packed = pack(pieces, max_len)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
