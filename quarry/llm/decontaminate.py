"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size, each broadcast to two passes over all
documents, so neither the items nor the documents have to fit anywhere.

1. **Frequencies.**  The first pass counts the documents that hold each pair of neighbouring words of the items.
2. **Seeds.**  An item's rare pairs are its seeds.  Of an item with few rare pairs, as one that leaked often, the
   ``LEAST_SEEDS`` rarest are seeds.  Pairs are short, so they lie between dense edits: where one word in
   three is changed every third pair is whole.
3. **Join.**  The second pass meets documents and items by their seeds; in a document a pair may
   have one word between its two, so added words do not part it.  A stretch of a document counts for an item
   when two of its seeds meet it there.
4. **Bound.**  A stretch that lacks so many of the item's words that no alignment can reach the
   threshold is left out; nothing is lost by that.
5. **Alignment.**  The words of items and stretches are aligned locally, many pairs at once; the score is
   divided by that of a perfect copy.  A passage as good as ``PASSAGE`` words in a
   row, which chance does not give, is a leak at any share of a longer item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, prepare, row_hash
from quarry.llm.words import Words, blocks, hash_words, mix

#: Items, and characters of items, of a block at most.
BLOCK_ITEMS, BLOCK_CHARS = 100_000, 24_000_000
#: An item's rarest pairs that are seeds in any case.
LEAST_SEEDS = 16
#: Pairs in more documents than these are frequent, by share and by number.
FREQUENT_SHARE, FREQUENT_DOCUMENTS = 0.001, 20
#: Words of an item from which two seeds must meet a stretch; shorter ones have few pairs.
TWO_HITS_FROM = 8
#: Words of stretches that wait for alignment, and pairs that are aligned together, at most.
CELLS, TOGETHER = 1 << 18, 256
#: Words from which a stretch is aligned in overlapping parts.
LONG_STRETCH = 4096
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of a perfect copy from which an item counts as leaked.
THRESHOLD = 0.5
#: Matched words, less edits, from which a passage of a longer item counts as leaked at any share of its score.
PASSAGE = 50
#: Words that a stretch reaches beyond the item on either side, relative to its length.
SLACK = 0.25

HITS = "doc_id long, item_id long, score double, start_word int, end_word int, row binary"


def pairs_of(words: Words, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the pairs of words that stand ``gap`` apart in a text, and the text and the place of each."""
    n = len(words.hashes) - gap
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(words.starts) - 1), words.counts)
    inside = np.flatnonzero(text[:-gap] == text[gap:])
    first, second = words.hashes[inside], words.hashes[inside + gap]
    return mix(first * np.uint64(31) + second), text[inside], inside - words.starts[text[inside]]


def single_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of one word, which have no pairs."""
    text = np.flatnonzero(words.counts == 1)
    return mix(words.hashes[words.starts[text]] + np.uint64(7)), text, np.zeros(len(text), dtype=np.int64)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


class Members:
    """A sorted set of hashes with a bit table in front of it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = min(26, max(16, int(len(hashes) * 8).bit_length()))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self._slot(hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``hashes`` are members, and from where to where each stands in the set."""
        maybe = np.flatnonzero(self.table[self._slot(hashes)])
        lo = np.searchsorted(self.hashes, hashes[maybe])
        hi = np.searchsorted(self.hashes, hashes[maybe], side="right")
        found = hi > lo
        return maybe[found], lo[found], hi[found]


class Items:
    """A block of test items: word hashes, and the pairs of neighbouring words."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.words = hash_words(texts)
        self.lengths = self.words.counts
        self.pairs, self.item, self.place = _joined([pairs_of(self.words, 1), single_words(self.words)])
        self.different = np.unique(self.pairs)

    def seeds(self, holding: np.ndarray, n_documents: int) -> Seeds:
        """The rarest pairs of each item, given how many documents hold each of ``different``."""
        df = holding[np.searchsorted(self.different, self.pairs)]
        # By item, rarest first.  Pairs of about one frequency are taken in any order: that an edited copy lacks a pair must not make it a seed.
        order = np.lexsort((self.place, mix(self.pairs), np.log2(df + 1).astype(np.int64), self.item))
        rank = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order])
        rare = df[order] <= max(FREQUENT_DOCUMENTS, FREQUENT_SHARE * n_documents)
        kept = order[(df[order] > 0) & (rare | (rank < LEAST_SEEDS))]
        kept = kept[np.argsort(self.pairs[kept], kind="stable")]
        return Seeds(self, self.pairs[kept], self.item[kept], self.place[kept])


@dataclass
class Seeds:
    items: Items
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def __post_init__(self):
        self.members = Members(self.hashes)


def align_all(items: list[np.ndarray], stretches: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """For each pair of word sequences the best local alignment score, and where it begins and ends in the second.

    All pairs are aligned together, one word of the items at a time.
    """
    if not items:
        return []
    count, m, n = len(items), max(map(len, items)), max(map(len, stretches))
    a, b = np.zeros((m, count, 1), dtype=np.uint64), np.full((count, n), np.uint64(1))
    known_a, known_b = np.zeros((m, count, 1), dtype=bool), np.zeros((count, n), dtype=bool)
    for k, (x, y) in enumerate(zip(items, stretches, strict=True)):
        a[: len(x), k, 0], known_a[: len(x), k, 0] = x, True
        b[k, : len(y)], known_b[k, : len(y)] = y, True
    column = np.arange(n + 1, dtype=np.int32)
    above, above_from = np.zeros((count, n + 1), dtype=np.int32), np.broadcast_to(column, (count, n + 1)).copy()
    best, begin, end = (np.zeros(count, dtype=np.int32) for _ in range(3))
    rows = np.arange(count)
    for i in range(m):
        diagonal = above[:, :-1] + np.where((a[i] == b) & known_a[i] & known_b, MATCH, MISMATCH).astype(np.int32)
        here = np.maximum(np.maximum(diagonal, above[:, 1:] + GAP), 0)
        source = np.where(here == 0, column[1:], np.where(here == diagonal, above_from[:, :-1], above_from[:, 1:]))
        # Gaps along the row: the best of all cells to the left, less the way from there.
        way = here - GAP * column[1:]
        top = np.maximum.accumulate(way, axis=1)
        leader = np.maximum.accumulate(np.where(way == top, column[1:], 0), axis=1)
        row = np.maximum(top + GAP * column[1:], 0)
        above[:, 1:] = row
        above_from[:, 1:] = np.where(row == 0, column[1:], np.take_along_axis(source, leader - 1, axis=1))
        k = above.argmax(axis=1)
        reached = above[rows, k]
        better = reached > best
        best[better], end[better], begin[better] = reached[better], k[better], above_from[rows, k][better]
    return list(zip(best.tolist(), begin.tolist(), end.tolist(), strict=True))


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """The same for one pair."""
    return align_all([item], [stretch])[0]


def _document_pairs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbours and of words with one between them: a word that was added between two is skipped."""
    return _joined([pairs_of(words, 1), pairs_of(words, 2), single_words(words)])


def _count_pairs(different: np.ndarray):
    """How many documents hold each pair of a block of items, and how many documents there are (number -1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, counts, documents = Members(different), np.zeros(len(different), dtype=np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, texts in blocks(batch.column(1).to_pylist()):
                hashes, text, _ = _document_pairs(hash_words(texts))
                at, number, _ = members.find(hashes)
                own = np.unique(text[at] * len(different) + number) % len(different) if len(at) else number
                counts += np.bincount(own, minlength=len(different))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int64()), pa.array([*counts[some].tolist(), documents], pa.int64())], ["pair", "n"])

    return task


def _stretches(seeds: Seeds, words: Words) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, and first and last word of the parts of texts that meet an item's seeds often enough."""
    hashes, text, place = _document_pairs(words)
    at, lo, hi = seeds.members.find(hashes)
    if not len(at):
        return
    reps = hi - lo
    which = np.repeat(lo, reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    t, p, item, q = np.repeat(text[at], reps), np.repeat(place[at], reps), seeds.item[which], seeds.place[which]
    order = np.lexsort((q, p, item, t))
    t, p, item, q = t[order], p[order], item[order], q[order]
    length = seeds.items.lengths[item]
    slack = (SLACK * length).astype(np.int64) + 4
    # A hit counts if another seed of the item is met within the length of the item.
    same = (t[1:] == t[:-1]) & (item[1:] == item[:-1]) & (p[1:] - p[:-1] <= length[1:] + slack[1:])
    other = same & (q[1:] != q[:-1])
    # Hits near each other make one stretch.
    run = np.cumsum(np.concatenate([[True], ~same])) - 1
    pairs = np.bincount(run[1:], weights=other, minlength=run[-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    good = (pairs > 0) | (length[first] < TWO_HITS_FROM)
    begin = np.minimum.reduceat(p - q, first) - slack[first]
    end = np.maximum.reduceat(p - q, first) + length[first] + slack[first]
    counts = words.counts
    for k in np.flatnonzero(good).tolist():
        n = int(counts[t[first[k]]])
        yield int(t[first[k]]), int(item[first[k]]), max(0, int(begin[k])), min(n, int(end[k]))


def _find(seeds: Seeds, threshold: float):
    items = seeds.items

    def leaks(words: Words) -> Iterator[tuple[int, int, float, int, int]]:
        """Hits of a block of texts: text number, item number, score, first and last word."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        waiting: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        cells = 0

        def settle() -> None:
            nonlocal cells
            waiting.sort(key=lambda w: len(w[4]))  # alike in size, so little is filled up
            for k in range(0, len(waiting), TOGETHER):
                part = waiting[k : k + TOGETHER]
                for (t, i, x, wanted, _), (score, start, end) in zip(part, align_all([w[3] for w in part], [w[4] for w in part]), strict=True):
                    share = score / (MATCH * len(wanted))
                    if score >= MATCH * min(threshold * len(wanted), PASSAGE) and share > best.get((t, i), (0.0,))[0]:
                        best[t, i] = (share, x + start, x + end)
            waiting.clear()
            cells = 0

        for t, i, begin, stop in _stretches(seeds, words):
            wanted = items.words.hashes[items.words.starts[i] : items.words.starts[i + 1]]
            # An alignment with a positive score reaches over less than three times the item's words.
            reach = 3 * len(wanted)
            for x in range(begin, max(begin + 1, stop - reach), max(LONG_STRETCH, reach)):
                own = words.hashes[words.starts[t] + x : words.starts[t] + min(stop, x + max(LONG_STRETCH, reach) + reach)]
                if np.count_nonzero(np.isin(wanted, own)) < min(threshold * len(wanted), PASSAGE):
                    continue
                waiting.append((t, i, x, wanted, own))
                cells += len(own)
                if cells > CELLS:
                    settle()
        settle()
        for (t, i), (share, start, end) in best.items():
            yield t, i, share, start, end

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for at, texts in blocks(batch.column(1).to_pylist()):
                out += [(ids[at + k], items.ids[i], score, a, b, rows[at + k]) for k, i, score, a, b in leaks(hash_words(texts))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word", "row"])

    return task


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items in blocks.  They come to the driver one partition at a time, and leave it block by block."""
    ids, texts, size = [], [], 0
    own = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    for r in own.toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(r["text"]) > BLOCK_CHARS):
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield Items(ids, texts)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The leaked items of every document: doc_id, item_id, score, start_word, end_word, row.

    ``score`` is 1 for a verbatim copy; words count from 0 in the document's words and
    ``end_word`` is not included; ``row`` is the digest of identifier and text.
    Documents and items without a word never meet.  An item of one word is
    found where a document consists of just that word.  Repeated rows and items give
    their own hits; null ids stay null; without hits, documents or items there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_hash("id"))
    prepare(spark)
    out = None
    for block in item_blocks(items, item_id_col, item_text_col):
        if not len(block.pairs):
            continue
        counted = arrow_map(rows, _count_pairs(block.different), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # two numbers a pair of the block
        holding = np.zeros(len(block.different) + 1, dtype=np.int64)  # the number of documents comes last
        holding[counted["pair"].to_numpy()] = counted["n"].to_numpy()
        hits = arrow_map(rows, _find(block.seeds(holding[:-1], int(holding[-1])), threshold), HITS)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], HITS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")
