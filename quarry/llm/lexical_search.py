"""Ranked lexical search by sort-based accumulation of impacts.

Items (the queries) are taken in blocks of bounded size; a block's terms and, for each term, its
items go to all tasks.  Two passes over whole texts:

1. **Statistics.**  The documents that hold each term of the block, the documents with a term at
   all, and all terms; tasks add up before anything is shuffled.
2. **Scores.**  A document's matched terms give impacts.  Concatenated arrays of items, documents
   and impacts get packed keys (item, document), which a radix sort brings together; sums over
   runs of equal keys are the scores.  All terms of a document meet in its task, so no
   impact is shuffled.  A heap for each item selects the task's best documents.

The best of all tasks are dealt out by ranges of items, where the final ranks are made.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map

TOP = 10
#: Parameters of the score: k1 times 1000 and b in hundredths are 1000 and 90.
B_HUNDREDTHS = 90
#: Items, and bytes of items, of a block at most.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 4_000_000
#: Bytes of a text that are split at once.
PIECE_BYTES = 1 << 22
#: Impacts that are sorted at once; a document with more comes alone, and a block bounds what one has.
CHUNK = 1 << 21
#: Groups in which an item's candidates are ranked first, so that many tasks' candidates do not meet in one.
SALTS = 64

_WORD = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
#: Bytes of terms, A-Z lower-cased, and blanks for all others.
_FOLDED = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD[b] else 32 for b in range(256))


def terms_of(text: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size; no term is cut."""
    folded, at = text.translate(_FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + piece) if at + piece < len(folded) else len(folded)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Items:
    """A block of items: their terms, numbered from 1, and the items that hold each."""

    def __init__(self, rows: list[tuple[int | None, bytes]], first: int):
        self.first, self.ids = first, [i for i, _ in rows]
        self.terms: dict[bytes, int] = {}
        pairs = []
        for k, (_, text) in enumerate(rows):
            for term in {t for part in terms_of(text) for t in part}:
                pairs.append((self.terms.setdefault(term, len(self.terms) + 1), k))
        pairs.sort()
        number = np.array([t for t, _ in pairs], dtype=np.int64)
        self.items = np.array([k for _, k in pairs], dtype=np.int64)
        #: The items of term t are ``items[starts[t]:starts[t + 1]]``.
        self.starts = np.searchsorted(number, np.arange(len(self.terms) + 2))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks.  They come to the driver one partition at a time, and leave it block by block."""
    rows, size, first = [], 0, 0
    own = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).where(F.col("text").isNotNull())
    for r in own.toLocalIterator():
        if rows and (len(rows) >= BLOCK_ITEMS or size + len(r["text"]) > BLOCK_BYTES):
            yield Items(rows, first)
            first, rows, size = first + len(rows), [], 0
        rows.append((r["id"], bytes(r["text"])))
        size += len(r["text"])
    if rows:
        yield Items(rows, first)


def _statistics(terms: dict[bytes, int]):
    wanted = terms.keys()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding: Counter[bytes] = Counter()
        documents = total = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen: set[bytes] = set()
                n = 0
                for part in terms_of(text or b""):
                    n += len(part)
                    seen |= wanted & set(part)
                holding.update(seen)
                documents, total = documents + (n > 0), total + n
        rows = [(terms[t], n) for t, n in holding.items()] + [(0, documents), (-1, total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["term", "n"])

    return task


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts whole keys of so many bits, 16 bits at a time; equal keys keep theirs."""
    order = None
    for shift in range(0, max(bits, 1), 16):
        digit = ((keys if order is None else keys[order]) >> shift).astype(np.uint16)
        own = np.argsort(digit, kind="stable")  # a radix sort for 16-bit integers
        order = own if order is None else order[own]
    return order


def accumulate(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, document and sum of the impacts of each pair that has some, sorted by item and then document."""
    low = max(1, int(n_docs - 1).bit_length())
    keys = (items << low) | docs
    order = radix_order(keys, low + int(max(n_items - 1, 1)).bit_length())
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first] >> low, keys[first] & ((1 << low) - 1), np.add.reduceat(impacts[order], first)


class Heaps:
    """The best documents of each item so far; of equal scores those of smaller ids, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.ones(n, dtype=np.int64)  # a score of 0 is no hit

    def offer(self, items: np.ndarray, ids: list[int | None], docs: np.ndarray, sums: np.ndarray) -> None:
        for j in np.flatnonzero(sums >= self.least[items]).tolist():
            item, doc = int(items[j]), ids[docs[j]]
            heap, entry = self.heaps[item], (int(sums[j]), doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def _best(block: Items, weights: np.ndarray, n_documents: int, n_terms: int, k: int):
    number, starts, holders, ids_of_items, first_item = block.terms.get, block.starts, block.items, block.ids, block.first

    def matched(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the terms that the block has, how often each occurs, and the number of all terms."""
        parts, n = [], 0
        for part in terms_of(text):
            n += len(part)
            found = np.fromiter(filter(None, map(number, part)), dtype=np.int64)
            if len(found):
                parts.append(np.unique(found, return_counts=True))
        if len(parts) < 2:
            return (*(parts[0] if parts else (np.zeros(0, dtype=np.int64),) * 2), n)
        terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return terms, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64), n

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(ids_of_items), k)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_ids: list[int | None] = []
        size = 0

        def settle() -> None:
            nonlocal held, held_ids, size
            if size:
                terms = np.concatenate([t for t, _ in held])
                impacts = np.concatenate([i for _, i in held])
                docs = np.repeat(np.arange(len(held)), [len(t) for t, _ in held])
                reps = starts[terms + 1] - starts[terms]
                place = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(starts[terms], reps)
                items, docs, sums = accumulate(holders[place], np.repeat(docs, reps), np.repeat(impacts, reps), len(held), len(ids_of_items))
                heaps.offer(items, held_ids, docs, sums)
            held, held_ids, size = [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms, tf, n = matched(text or b"")
                if not len(terms):
                    continue
                m = 100 - B_HUNDREDTHS + (B_HUNDREDTHS * n * n_documents) // n_terms
                own = int((starts[terms + 1] - starts[terms]).sum())
                if size and size + own > CHUNK:
                    settle()
                held.append((terms, weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))))
                held_ids.append(doc_id)
                size += own
        settle()
        out = [(first_item + j, ids_of_items[j], -minus if has else None, score) for j, heap in enumerate(heaps.heaps) for score, has, minus in heap]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "item_id", "doc_id", "score"])

    return task


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 for each item.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII in the whole text, only A-Z lower-cased.  With N documents that
    have a term, L terms in all, n in the document and df documents that hold a term, a term weighs
    ``floor(1000 * ln((2N + 2) / (2df + 1)))``, which may be below 0, and adds
    ``weight * (10^9 tf div (1000 tf + 8 m))`` with ``m = 10 + 90 n N div L``, once for each different term of the item.
    Equal scores go by the smaller doc_id, null ids last.  Null and empty texts have no terms:
    such documents are no hits, such items have none.  Repeated documents are hits of their own, repeated items have rows of their own.
    Other columns are ignored; without documents or items there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, item_id_col, item_text_col):
        if not block.terms:
            continue
        counted = {r["term"]: r["n"] for r in arrow_map(rows, _statistics(block.terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_documents, n_terms = counted.get(0, 0), counted.get(-1, 0)
        if not n_documents:
            break
        weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * counted.get(t, 0) + 1))) if t else 0 for t in range(len(block.terms) + 1)], dtype=np.int64)
        best = arrow_map(rows, _best(block, weights, n_documents, n_terms, k), "item long, item_id long, doc_id long, score long")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    out = out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    out = out.repartitionByRange("item").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT i, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS_SQL} AS t FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, l WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), l GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
