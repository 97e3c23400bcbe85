"""Near duplicates by weighted Jaccard similarity of word shingles (BagMinHash).

A text is the multiset of its shingles of five words.  Its signature is BagMinHash's: each
shingle of weight ``w`` carries Poisson processes over the weights below ``w``, one for
each dyadic interval [0,1), [1,2), [2,4), ... (weights are counts, so unit steps are an exact
discretization).  A process has its own random stream; a point has a time, a signature
component and a place in its interval, and counts if the place lies below ``w``.  A
component keeps the earliest time.  Two texts agree in a component with probability equal
to their weighted Jaccard similarity.  Only points before a text's time limit are made:
the limit is set so that all components are almost surely filled, and is raised for the texts where
one is not, so the result never depends on it.

Signatures are cut into bands.  Texts that share a band meet in a bucket; the multiset
overlap of a pair is computed exactly before it counts.  No bucket emits all its pairs:

* equal texts are one node from the start,
* the members of a bucket are first compared with its *hub*, the member that most others
  share buckets with; near copies of one text thereby become one component,
* where a bucket still holds several components, members are compared across components in
  blocks of bounded size: those outside the largest component with each other and with all
  of it.  A block emits only links that join components, fewer than it has members.

So no link that could join two texts of a bucket is lost, and the work that is
quadratic touches only members outside the largest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import KeyFilter, arrow_map, discard, materialize, prepare, row_hash
from quarry.llm.graph import components
from quarry.llm.words import binary, blocks, hash_words, mix, shingles

SHINGLE = 5
SIMILARITY = 0.8
#: 20 bands of 4: a pair at 0.8 shares a band with probability 1 - (1 - 0.8^4)^20 = 0.99997.
BANDS, ROWS = 20, 4
#: Shingles of the members that a block of an open bucket holds, about.
BLOCK_SHINGLES = 1_000_000

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def bags(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of all texts: number of the text, shingle and count, sorted; and a key of each text's words."""
    words = hash_words(texts)
    h, doc = shingles(words, size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    raw, s = words.hashes.tobytes(), words.starts
    keys = [blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else b"" for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
    return doc[first], h[first], count, keys


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """``n`` rows of ``m`` earliest times; rows without shingles are infinite."""
    # One process for each dyadic interval that begins below the weight.
    intervals = np.where(count > 1, np.ceil(np.log2(count)).astype(np.int64), 0) + 1
    e = np.repeat(np.arange(len(count)), intervals)
    j = np.arange(len(e)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    low = np.where(j > 0, 2.0 ** (j - 1), 0.0)
    width = np.where(j > 0, low, 1.0)
    key = mix(shingle[e] ^ mix((j.astype(_U) + _U(1)) * _GOLD))
    weight, row = count[e].astype(float), doc[e]
    total = np.bincount(doc, count, n)
    sig = np.full(n * m, np.inf)
    limit = np.full(n, np.inf)
    np.divide(np.log(m) + 4.0, total, out=limit, where=total > 0)
    todo = np.flatnonzero(total > 0)
    live = np.arange(len(e))
    while len(todo):
        k, t, step = live, np.zeros(len(live)), _U(0)
        while len(k):
            step = _U((int(step) + int(_GOLD)) & 0xFFFFFFFFFFFFFFFF)
            x = mix(key[k] + step)
            t = t - np.log(((x >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (m * width[k])
            early = t <= limit[row[k]]
            k, t = k[early], t[early]
            if not len(k):
                break
            y = mix(x[early] ^ _GOLD)
            place = low[k] + ((y >> _U(32)).astype(float) * 2.0**-32) * width[k]
            counts = place < weight[k]
            at = row[k] * m + ((y & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64)
            np.minimum.at(sig, at[counts], t[counts])
        todo = todo[np.isinf(sig.reshape(n, m)[todo]).any(axis=1)]
        limit[todo] *= 4.0
        wanted = np.zeros(n, dtype=bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[row])
        sig.reshape(n, m)[todo] = np.inf
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket number per band; equal only where the band and all its rows are."""
    bits = np.ascontiguousarray(sig[:, : bands * rows]).view(_U).reshape(len(sig), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (len(sig), bands)).copy()
    for k in range(rows):
        out = mix(out * _U(31) + bits[:, :, k])
    return out.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    (ha, ca), (hb, cb) = a, b
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = hb[at] == ha if len(hb) else np.zeros(len(ha), dtype=bool)
    shared = np.minimum(ca[both], cb[at[both]]).sum()
    return float(shared / max(1, ca.sum() + cb.sum() - shared))


def _sign(size: int, bands: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1).to_pylist()):
                doc, h, count, keys = bags(texts, size)
                buckets = band_hashes(signatures(doc, h, count, len(texts), bands * rows), bands, rows)
                weight = np.bincount(doc, count, len(texts)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * bands + 1, bands, dtype=np.int32)), pa.array(buckets.ravel()))
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([k or None for k in keys], pa.binary()), pa.array(weight), lists], ["id", "row", "key", "weight", "buckets"])

    return task


def _compare(size: int, similarity: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for at, texts in blocks(batch.column(2).to_pylist()):
                hubs = {b[at + k]: batch.column(3)[at + k] for k in range(len(texts)) if b[at + k] not in kept}
                if len(kept) + len(hubs) > 256:
                    kept.clear()
                    hubs = {b[at + k]: batch.column(3)[at + k] for k in range(len(texts))}
                names = list(hubs)
                doc, h, count, _ = bags(texts + [hubs[x].as_py() for x in names], size)
                cut = np.searchsorted(doc, np.arange(len(texts) + len(names) + 1))
                bag = [(h[i:j], count[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                # Copies, so the cache doesn't hold the block.
                kept.update((x, (bag[len(texts) + k][0].copy(), bag[len(texts) + k][1].copy())) for k, x in enumerate(names))
                good += [at + k for k in range(len(texts)) if overlap(bag[k], kept[b[at + k]]) >= similarity]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.binary()), pa.array([b[k] for k in good], pa.binary())], ["a", "b"])

    return task


def _texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and text of the wanted nodes, found by their rows; other rows go on the map side."""
    target = materialize(nodes.join(wanted, "key", "left_semi").select("row", "key"), "wanted")
    return KeyFilter(target, "row").maybe(rows, "row").select("row", "text").join(target, "row").select("key", "text").dropDuplicates(["key"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, row.

    Texts with a weighted Jaccard similarity of at least ``similarity``, and chains of
    them, form a class; its id is its least doc_id, and that row is kept.  ``row`` is the
    digest of identifier and text.  Texts without a word are alone in their class, as
    nulls are; rows that share identifier and text are all kept or all not; a class of
    which no row has an identifier has none.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_hash("id"))
    signed = materialize(arrow_map(rows, _sign(size, bands, band_rows), "id long, row binary, key binary, weight long, buckets array<long>"), "signed")
    worded = signed.where(F.col("key").isNotNull())
    nodes = materialize(worded.select("key", "row", "weight", "buckets").dropDuplicates(["key"]), "nodes")
    members = _members(nodes)
    links = _links(rows, nodes, members, size, similarity)
    labels = components(links)
    discard(members, nodes)

    own = materialize(signed.select("id", "row", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("id", "row", F.coalesce("component", "key").alias("class")), "classed")
    discard(signed, labels)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = materialize(own.where(F.col("class").isNotNull()).groupBy("class").agg(first, F.count("*").alias("class_size")), "classes")
    # Texts without words take no part in the join, so they don't meet under one null key.
    out = own.where(F.col("class").isNotNull()).join(groups, "class").select("id", F.col("first.id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "row")
    out = out.unionByName(own.where(F.col("class").isNull()).select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "row"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept", "row")


def _members(nodes: DataFrame) -> DataFrame:
    """bucket, key, weight of the buckets with more than one node, and how many each has."""
    entries = nodes.select(F.explode("buckets").alias("bucket"), "key", "weight")
    # A stored list of buckets, so that Spark can split a bucket with very many members.
    shared = materialize(entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    out = materialize(entries.join(shared, "bucket"), "members")
    discard(shared)
    return out


def _links(rows: DataFrame, nodes: DataFrame, members: DataFrame, size: int, similarity: float) -> DataFrame:
    """Verified pairs that connect all nodes which any verified pair of a bucket connects."""
    popular = members.groupBy("key").agg(F.sum("n").alias("popularity"))
    hubs = materialize(members.join(popular, "key").groupBy("bucket").agg(F.max(F.struct("popularity", "key", "weight")).alias("hub")).select("bucket", F.col("hub.key").alias("b"), F.col("hub.weight").alias("w")), "hubs")
    met = members.join(hubs, "bucket").where(F.col("key") != F.col("b"))
    fits = F.least("weight", "w") >= F.greatest("weight", "w") * similarity
    pairs = materialize(met.where(fits).select(F.col("key").alias("a"), "b").distinct(), "pairs")
    links = _verify(rows, nodes, pairs, size, similarity)
    labels = components(links)

    # Hubs have met all their bucket; what is left of it may fall into several components.
    left = met.where(F.col("n") > 2).select("bucket", "key", "weight").join(labels.withColumnRenamed("node", "key"), "key", "left")
    left = materialize(left.select("bucket", "key", "weight", F.coalesce("component", "key").alias("component")), "left")
    discard(hubs, pairs, labels)
    parts = left.groupBy("bucket", "component").agg(F.sum("weight").alias("size"))
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("main")).where(F.col("parts") > 1)
    blocks_of = lambda x: F.ceil(x / BLOCK_SHINGLES).cast("int")
    open_ = materialize(open_.select("bucket", F.col("main.component").alias("main"), blocks_of(F.col("main.size")).alias("in_main"), blocks_of(F.col("all") - F.col("main.size")).alias("others")), "open")
    placed = left.join(open_, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("outside"), F.col("others")).otherwise(F.col("in_main"))).cast("int")
    # Tasks of a bucket: (i, j) for blocks i <= j outside, (i, others + j) for block i outside and j of the main component.
    placed = placed.withColumn("k", block).withColumn("all_others", F.sequence(F.lit(0), F.col("others") - 1))
    outside = F.concat(F.transform("all_others", lambda i: F.struct(F.least(i, "k").alias("i"), F.greatest(i, "k").alias("j"))), F.transform(F.sequence(F.col("others"), F.col("others") + F.col("in_main") - 1), lambda j: F.struct(F.col("k").alias("i"), j.alias("j"))))
    inside = F.transform("all_others", lambda i: F.struct(i.alias("i"), (F.col("others") + F.col("k")).alias("j")))
    tasks = placed.select("bucket", "key", "component", "outside", F.explode(F.when(F.col("outside"), outside).otherwise(inside)).alias("task"))
    texts = _texts(rows, nodes, left.join(open_, "bucket", "left_semi").select("key").distinct())
    work = tasks.select("bucket", "task.i", "task.j", "key", "component", "outside").join(texts, "key")
    prepare(rows.sparkSession)
    more = work.groupBy("bucket", "i", "j").applyInArrow(_join_parts(size, similarity), "a binary, b binary")
    more = materialize(more, "links")
    discard(left, open_)
    return links.unionByName(more)


def _join_parts(size: int, similarity: float):
    """Links that join the components of a block, of pairs that are not both in the main component."""

    def task(block: pa.Table) -> pa.Table:
        block = block.sort_by("key")
        keys, part, outside = block.column("key").to_pylist(), block.column("component").to_pylist(), np.array(block.column("outside").to_pylist())
        doc, h, count, _ = bags(block.column("text").to_pylist(), size)
        n = len(keys)
        cut = np.searchsorted(doc, np.arange(n + 1))
        weight = np.bincount(doc, count, n)
        names: dict[bytes, int] = {}
        label = np.array([names.setdefault(p, len(names)) for p in part])
        links = []
        # Each member outside the main component in turn meets all later members, and all of
        # the main component, that it is not connected to yet.
        for k in np.flatnonzero(outside):
            if (label == label[0]).all():
                break
            fits = np.minimum(weight, weight[k]) >= similarity * np.maximum(weight, weight[k])
            for_k = np.flatnonzero((label != label[k]) & fits & (~outside | (np.arange(n) > k)))
            if not len(for_k):
                continue
            own_h, own_c = h[cut[k] : cut[k + 1]], count[cut[k] : cut[k + 1]]
            at = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in for_k])
            place = np.searchsorted(own_h, h[at])
            place[place == len(own_h)] = 0
            shared = np.where(own_h[place] == h[at], np.minimum(own_c[place], count[at]), 0)
            shared = np.bincount(doc[at], shared, n)[for_k]
            for i in for_k[shared >= similarity * (weight[k] + weight[for_k] - shared)]:
                if label[i] != label[k]:
                    links.append((keys[k], keys[i]))
                    label[label == label[i]] = label[k]
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    return task


def _verify(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    texts = materialize(_texts(rows, nodes, wanted), "texts")
    first = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    links = materialize(arrow_map(met, _compare(size, similarity), "a binary, b binary"), "links")
    discard(texts)
    return links


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
