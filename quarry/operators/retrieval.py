"""Keyword, vector and hybrid retrieval, re-ranking by links, and exact lookup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import PATH_BOOST_SQL, has_symbol, identifiers, path_boost, regex_escape, tokenize, tokenize_sql
from quarry.registry import query
from quarry.sources.tables import CHUNKS_SQL, chunks, table

K1, B, PHRASE = 1.8, 0.35, 0.3
POOL, RRF = 60, 10


@dataclass(frozen=True)
class Index:
    """Long tables over chunks.  ``terms``: id, pos, term.  Every chunk counts in N and the mean length."""

    chunks: DataFrame
    terms: DataFrame

    def postings(self) -> DataFrame:
        return self.terms.groupBy("term", "id").agg(F.count("*").alias("tf"))

    def lengths(self) -> DataFrame:
        return self.chunks.select("id", F.size(tokenize(F.col("raw"))).alias("len"))


def build_index(chunks: DataFrame) -> Index:
    return Index(chunks, chunks.select("id", F.posexplode(tokenize(F.col("raw"))).alias("pos", "term")))


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def bm25(index: Index, query_terms: list[str], limit: int) -> DataFrame:
    """id, score of the best chunks.  Terms that are repeated in the query count again.

    One pass over the chunks: the query's terms are constants, so each chunk is reduced to
    its counts of them (and of their adjacent pairs) before anything is aggregated, and no
    posting is shuffled.
    """
    terms = sorted(set(query_terms))
    weight = {t: query_terms.count(t) for t in terms}
    pairs = [(a, b) for a, b in zip(query_terms, query_terms[1:], strict=False)]

    def counts(t: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        tf = [F.size(F.filter(t, _equals(w))).alias(f"tf{k}") for k, w in enumerate(terms)]
        return F.struct(F.size(t).alias("len"), *tf, *[joined.contains(f" {a} {b} ").cast("int").alias(f"pair{k}") for k, (a, b) in enumerate(pairs)])

    # The tokens are bound once by the lambda, however often the counts use them.
    count = lambda c: c.select("id", F.transform(F.array(tokenize(F.col("raw"))), counts).getItem(0).alias("c")).select("id", "c.*")
    counted = count(index.chunks)
    # Only a text that holds a term, in any case, can have a score.
    maybe = count(index.chunks.where(F.lower("raw").rlike("|".join(map(regex_escape, terms)) or "$.^")))
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    full = maybe.crossJoin(F.broadcast(stats))  # one row of statistics
    score: Column = F.lit(0.0)
    for k, t in enumerate(terms):
        tf, df, n = F.col(f"tf{k}"), F.col(f"df{k}"), F.col("n")
        idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, weight[t] * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
    for k in range(len(pairs)):
        score = score + PHRASE * F.col(f"pair{k}")
    hit = F.greatest(F.lit(0), *[F.col(f"tf{k}") for k in range(len(terms))]) > 0
    return full.where(hit).select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def bm25_sql(query_terms: list[str]) -> str:
    """CTEs that end in ``bm(id, score)``, from the definitions: postings, bigrams, lengths."""
    q = ", ".join(f"({i}, '{t}')" for i, t in enumerate(query_terms))
    return f"""toks AS (SELECT id, {tokenize_sql('raw')} AS t FROM chunks),
  lens AS (SELECT id, len(t) AS len FROM toks), st AS (SELECT count(*) AS n, avg(len) AS al FROM lens),
  post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY 1, 2),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
  q(i, term) AS (VALUES {q}),
  part AS (SELECT p.id, ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * {K1 + 1}) / (tf + {K1} * (1 - {B} + {B} * len / al)) AS s
           FROM q JOIN post p USING (term) JOIN dfs USING (term) JOIN lens ON lens.id = p.id, st),
  bi AS (SELECT DISTINCT id, list_extract(t, k) AS a, list_extract(t, k + 1) AS b FROM (SELECT id, t, unnest(range(1, len(t))) AS k FROM toks)),
  qb AS (SELECT x.term AS a, y.term AS b FROM q x JOIN q y ON y.i = x.i + 1),
  ph AS (SELECT bi.id, {PHRASE} AS s FROM qb JOIN bi USING (a, b)),
  bm AS (SELECT id, round(sum(s), 9) AS score FROM (SELECT * FROM part UNION ALL SELECT * FROM ph) GROUP BY 1)"""


QUERY = ["ndnt", "thtion", "ined", "ing", "ined"]


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 for vectors of different length."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def knn(vectors: DataFrame, query_vector: DataFrame, limit: int) -> DataFrame:
    """id, distance of the nearest vectors to the one row of ``query_vector``."""
    one = query_vector.limit(1).select(F.col("embedding").alias("_q"))
    return vectors.crossJoin(F.broadcast(one)).select("id", F.round(1 - dot(F.col("embedding"), F.col("_q")), 9).alias("distance")).orderBy("distance", "id").limit(limit)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


KNN_SQL = "knn AS (SELECT e.vec_id AS id, round(1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


@query("r2_knn", f"WITH {KNN_SQL} SELECT id, round(distance, 6) + 0.0 AS distance FROM knn ORDER BY knn.distance, id LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return knn(v, v.where("id = 7"), 20).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("r5_vector_search", f"WITH {CHUNKS_SQL}, {KNN_SQL}, top AS (SELECT * FROM knn ORDER BY distance, id LIMIT 10) SELECT id, path, round(1 - distance, 6) AS score FROM top JOIN chunks USING (id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    top = knn(v, v.where("id = 7"), 10)
    return chunks(spark, sf_dir).select("id", "path").join(F.broadcast(top), "id").select("id", "path", F.round(1 - F.col("distance"), 6).alias("score"))


HYBRID_SQL = f"""{bm25_sql(QUERY)}, {KNN_SQL},
  kw AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= {POOL}),
  vec AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM knn QUALIFY r <= {POOL}),
  fused AS (SELECT id, coalesce(1.0 / ({RRF} + kw.r), 0) + coalesce(1.0 / ({RRF} + vec.r), 0) AS rrf FROM kw FULL JOIN vec USING (id)),
  hyb AS (SELECT id, path, round(rrf * {PATH_BOOST_SQL}, 9) AS score FROM fused JOIN chunks USING (id))"""


def rerank(results: DataFrame, vertices: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Weights results by the place of their path in a graph of paths.

    ``results``: id, path, score.  ``vertices``: path, tier, in_degree.  ``edges``: src, dst.
    The first three results are epicenters; what an epicenter is linked from by another
    result's path gets half as much again.
    """
    # Results are a short list (5 x limit at most), so windows over all of it are small.
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    epicenters = ranked.where("rank <= 3").select(F.col("path").alias("dst")).distinct()
    blast = edges.join(F.broadcast(epicenters), "dst").where(F.col("src") != F.col("dst")).select(F.col("src").alias("path")).distinct().withColumn("is_blast", F.lit(True))
    joined = ranked.join(vertices, "path", "left").join(blast, "path", "left")
    tier = F.coalesce("tier", F.lit("orphan"))
    gravity = F.when(F.col("tier").isNull(), 1.0).otherwise(1 + F.when(tier == "core", 0.5).when(tier == "logic", 0.2).otherwise(0.0) + 0.15 * F.log2(1 + F.coalesce("in_degree", F.lit(0))))
    score = F.col("score") * gravity * F.when(F.col("is_blast"), 1.5).otherwise(1.0)
    out = joined.select("id", "path", F.round(score, 6).alias("score"), tier.alias("tier"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), (F.col("rank") <= 3).alias("is_top3"), F.coalesce("is_blast", F.lit(False)).alias("is_blast"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


LINKS_SQL = """links AS (SELECT a.source AS src, b.source AS dst FROM (SELECT DISTINCT source FROM documents) a, (SELECT DISTINCT source FROM documents) b
    WHERE a.source <> b.source AND (CAST(substr(a.source, 4) AS INTEGER) * 3 + CAST(substr(b.source, 4) AS INTEGER)) % 7 = 0),
  verts AS (SELECT dst AS source, count(*) AS in_degree, CASE WHEN count(*) >= 4 THEN 'core' WHEN count(*) >= 3 THEN 'logic' ELSE 'leaf' END AS tier FROM links GROUP BY 1)"""


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A small graph of the (twenty or so) sources by a fixed rule."""
    s = table(spark, sf_dir, "documents").select("source").distinct()
    n = lambda c: F.substring(c, 4, 10).cast("int")
    pairs = s.select(F.col("source").alias("src"), n("source").alias("a")).join(s.select(F.col("source").alias("dst"), n("source").alias("b")), (F.col("src") != F.col("dst")) & ((F.col("a") * 3 + F.col("b")) % 7 == 0))
    edges = pairs.select("src", "dst")
    degree = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    return degree.withColumn("tier", F.when(F.col("in_degree") >= 4, "core").when(F.col("in_degree") >= 3, "logic").otherwise("leaf")), edges


def topology_sql() -> str:
    return f"""WITH {CHUNKS_SQL}, {bm25_sql(QUERY)}, {LINKS_SQL},
  res AS (SELECT id, symbol_name AS path, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm JOIN chunks USING (id) QUALIFY rank <= 50),
  epi AS (SELECT DISTINCT path FROM res WHERE rank <= 3), bl AS (SELECT DISTINCT src AS path FROM links WHERE dst IN (SELECT path FROM epi) AND src <> dst)
  SELECT id, r.path, round(score * CASE WHEN v.tier IS NULL THEN 1 ELSE 1 + CASE v.tier WHEN 'core' THEN 0.5 WHEN 'logic' THEN 0.2 ELSE 0 END + 0.15 * log2(1 + v.in_degree) END * CASE WHEN bl.path IS NOT NULL THEN 1.5 ELSE 1 END, 6) AS score,
    coalesce(v.tier, 'orphan') AS tier, coalesce(v.in_degree, 0) AS in_degree, rank <= 3 AS is_top3, bl.path IS NOT NULL AS is_blast
  FROM res r LEFT JOIN verts v ON v.source = r.path LEFT JOIN bl ON bl.path = r.path ORDER BY 3 DESC, id LIMIT 10"""


def definitions(chunks: DataFrame, symbol: str, kinds: list[str] | None = None) -> DataFrame:
    """Chunks of a symbol: exact matches first, then those that differ in case."""
    found = chunks.where(F.lower("symbol_name") == symbol.lower())
    if kinds:
        found = found.where(F.col("node_type").isin(kinds))
    return found.select("id", "path", "symbol_name", "node_type", F.when(F.col("symbol_name") == symbol, 0).otherwise(1).alias("priority")).orderBy("priority", "id")


@query("r7_definition", f"WITH {CHUNKS_SQL} SELECT id, path, symbol_name, node_type, CASE WHEN symbol_name = 'SRC3' THEN 0 ELSE 1 END AS priority FROM chunks WHERE lower(symbol_name) = 'src3' AND node_type IN ('en', 'fr')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions(chunks(spark, sf_dir), "SRC3", ["en", "fr"])


def lines_of(chunks: DataFrame, text: str = "raw") -> DataFrame:
    """id, line number from 1, line."""
    return chunks.select("id", F.posexplode(F.split(text, "\n")).alias("_p", "line")).select("id", (F.col("_p") + 1).cast("long").alias("line_no"), "line")


def references(chunks: DataFrame, symbol: str) -> DataFrame:
    """First whole-word hit of each line with its column from 1 and the lines around it."""
    candidates = chunks.where(F.col("raw").contains(symbol))
    lines = candidates.select("id", F.split("raw", "\n").alias("ls"))
    hit = r"(?<![a-zA-Z0-9_$])" + regex_escape(symbol) + r"(?![a-zA-Z0-9_$])"
    rows = lines.select("id", "ls", F.posexplode("ls").alias("p", "line")).where(has_symbol(F.col("line"), symbol))
    return rows.select("id", (F.col("p") + 1).cast("long").alias("line_no"), F.regexp_instr("line", F.lit(hit)).cast("long").alias("col_no"), "line", F.get("ls", F.col("p") - 1).alias("before"), F.get("ls", F.col("p") + 1).alias("after"))


@query("r8_references", """WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, 'thtion')), x AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS p FROM l)
  SELECT id, p AS line_no, length(regexp_extract(ls[p], '^(.*?)(^|[^a-zA-Z0-9_$])thtion($|[^a-zA-Z0-9_$])', 1)) + length(regexp_extract(ls[p], '^(.*?)(^|[^a-zA-Z0-9_$])thtion($|[^a-zA-Z0-9_$])', 2)) + 1 AS col_no, ls[p] AS line,
         CASE WHEN p > 1 THEN ls[p - 1] END AS before, CASE WHEN p < len(ls) THEN ls[p + 1] END AS after
  FROM x WHERE regexp_matches(ls[p], '(^|[^a-zA-Z0-9_$])thtion($|[^a-zA-Z0-9_$])')""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(chunks(spark, sf_dir), "thtion")


def grep(chunks: DataFrame, text: str, limit: int) -> DataFrame:
    """Lines that hold ``text`` exactly, in order of chunk and line; the filter reaches the scan."""
    hits = lines_of(chunks.where(F.col("raw").contains(text)).select("id", "raw")).where(F.col("line").contains(text))
    return hits.orderBy("id", "line_no").limit(limit)


@query("r9_fast_grep", "WITH x AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents) SELECT id, p AS line_no, ls[p] AS line FROM x WHERE contains(ls[p], 'License') ORDER BY id, p LIMIT 50")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(chunks(spark, sf_dir), "License", 50)


@query("f1_substring", f"WITH {CHUNKS_SQL} SELECT id, path, symbol_name FROM chunks WHERE contains(raw, 'The ') ORDER BY id LIMIT 40")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(F.col("raw").contains("The ")).select("id", "path", "symbol_name").orderBy("id").limit(40)


@query("f2_like", f"WITH {CHUNKS_SQL} SELECT id, path FROM chunks WHERE raw ILIKE '%licen_e%'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(F.col("raw").ilike("%licen_e%")).select("id", "path")


@query("f4_identifier_member", "SELECT doc_id AS id FROM documents WHERE list_contains(regexp_extract_all(text, '[a-zA-Z_$][a-zA-Z0-9_$]*'), 'ing')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(F.array_contains(identifiers(F.col("raw")), "ing")).select("id")


@query("f5_whole_symbol", "SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '(^|[^a-zA-Z0-9_$])ining($|[^a-zA-Z0-9_$])')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(has_symbol(F.col("raw"), "ining")).select("id")


@query("f6_path_boost", f"WITH {CHUNKS_SQL} SELECT id, CAST({PATH_BOOST_SQL} AS DOUBLE) AS boost FROM chunks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("id", path_boost(F.col("path")).alias("boost"))


@query("f7_kind_filter", f"WITH {CHUNKS_SQL} SELECT id, CASE node_type WHEN 'en' THEN 'class' WHEN 'fr' THEN 'function' ELSE 'variable' END AS kind FROM chunks WHERE node_type IN ('en', 'fr')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ["en", "class", "fr", "function", "de", "variable", "es", "variable"]))
    return chunks(spark, sf_dir).select("id", F.try_element_at(kinds, F.col("node_type")).alias("kind")).where(F.col("kind").isin("class", "function"))


@query("t2_index_terms", f"WITH {CHUNKS_SQL}, t AS (SELECT id, unnest({tokenize_sql('raw')}) AS term FROM chunks) SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM t GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Document frequency from per-document counts: one shuffle by (term, id), then one by term.
    return build_index(chunks(spark, sf_dir)).postings().groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("a5_index_statistics", f"WITH {CHUNKS_SQL}, t AS (SELECT id, len({tokenize_sql('raw')}) AS n FROM chunks) SELECT count(*) AS n_docs, round(avg(n), 6) AS avg_len, CAST(sum(n) AS BIGINT) AS total FROM t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(chunks(spark, sf_dir)).lengths().agg(F.count("*").alias("n_docs"), F.round(F.avg("len"), 6).alias("avg_len"), F.sum("len").cast("long").alias("total"))


@query("w13_bigrams", f"WITH {CHUNKS_SQL}, t AS (SELECT id, {tokenize_sql('raw')} AS t FROM chunks), b AS (SELECT DISTINCT id, list_extract(t, k) || ' ' || list_extract(t, k + 1) AS bigram FROM (SELECT id, t, unnest(range(1, len(t))) AS k FROM t)) SELECT bigram, count(*) AS df FROM b GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunks(spark, sf_dir).select("id", tokenize(F.col("raw")).alias("t"))
    pairs = F.zip_with("t", F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    own = t.where(F.size("t") > 1).select("id", F.explode(F.array_distinct(F.slice(pairs, 1, F.size("t") - 1))).alias("bigram"))
    return own.groupBy("bigram").agg(F.count("*").alias("df"))


@query("j27_lateral_top_k", f"""WITH {CHUNKS_SQL}, syms AS (SELECT * FROM (VALUES ('thtion'), ('ining'), ('ndnt')) s(symbol)),
  c AS (SELECT symbol, id, path, row_number() OVER (PARTITION BY symbol ORDER BY length(raw), id) AS rank FROM syms JOIN chunks ON regexp_matches(raw, '(^|[^a-zA-Z0-9_$])' || symbol || '($|[^a-zA-Z0-9_$])'))
  SELECT symbol, id, path, rank FROM c WHERE rank <= 3""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The symbols are constants: one scan marks each chunk with those it holds, then top 3 per symbol.
    symbols = ["thtion", "ining", "ndnt"]
    held = F.filter(F.array(*[F.when(has_symbol(F.col("raw"), s), F.lit(s)) for s in symbols]), lambda s: s.isNotNull())
    rows = chunks(spark, sf_dir).select("id", "path", F.length("raw").alias("n"), F.explode(held).alias("symbol"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("n", "id"))
    return rows.withColumn("rank", rank).where("rank <= 3").select("symbol", "id", "path", "rank")
