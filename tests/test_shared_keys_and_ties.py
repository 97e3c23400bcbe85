"""Rows that share a key, ties, and sums whose order matters."""

from pyspark.sql import functions as F

from quarry.sources import maintenance, tail


def test_manifests_tell_files_of_one_path_apart(spark):
    files = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("q", "d", 4)], "path string, digest string, page_id long")
    key = F.substring(F.sha2("path", 256), 1, 16).alias("key")
    known = files.where("page_id in (2, 3)").select(key, "page_id", F.when(F.col("page_id") == 3, "old").otherwise(F.col("digest")).alias("digest"), F.lit(maintenance.MANIFEST_VERSION).alias("version"))
    found = maintenance.manifest_status(files, known, ("page_id",)).groupBy("key").agg(F.sort_array(F.collect_list("status")).alias("s")).orderBy(F.size("s"))
    assert [r.s for r in found.collect()] == [["missing"], ["fresh", "missing", "stale"]]


def test_a_file_with_several_entries_has_one_status(spark):
    files = spark.createDataFrame([("p", "a")], "path string, digest string")
    known = files.select(F.substring(F.sha2("path", 256), 1, 16).alias("key"), F.explode(F.array(F.lit("a"), F.lit("z"))).alias("digest")).withColumn("version", F.when(F.col("digest") == "a", maintenance.MANIFEST_VERSION).otherwise(maintenance.MANIFEST_VERSION - 1))
    assert [r.status for r in maintenance.manifest_status(files, known).collect()] == ["fresh"]


def test_growing_files_begin_alike_whatever_the_order_of_their_rows(spark, tmp_path):
    rows = spark.range(4).select(F.col("id").alias("event_id"), F.lit(0).alias("file"), (F.col("id") % 2).alias("half"), F.concat(F.lit("good "), F.col("id").cast("string")).alias("line"))
    broken = rows.where("event_id < 2").withColumn("line", F.lit("broken"))
    for part, both in enumerate((rows.unionByName(broken), broken.unionByName(rows))):
        tail._grow(both.coalesce(1), f"file://{tmp_path}/{part}", part)
    first, second = ((tmp_path / str(k) / "0.jsonl").read_bytes() for k in (0, 1))
    assert second.startswith(first) and second.count(b"\n") == 6


def test_tokens_are_added_in_one_order(spark):
    tokens = [0.1, 0.7, 0.2] * 30  # in this order 29.999999999999986, in seven parts 30
    calls = spark.createDataFrame([("u", "t", x, k) for k, x in enumerate(tokens)], "user string, tool string, tokens double, id long")
    parts = calls.repartitionByRange(7, F.col("id") % 7)
    assert {r.text for df in (calls, parts) for r in maintenance.usage_report(df).collect()} == {"total: 90 calls, 29 tokens\nt: 90 calls, 29 tokens"}


def test_source_files_are_made_of_keys_and_equal_their_pieces(spark):
    from quarry.sources import corpus

    sf = "/root/testdata/sf0.001"
    files = corpus.source_files(spark, sf)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    whole = corpus.pieces(spark, sf).groupBy("path").agg(F.array_join(texts, "").alias("code"))
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, whole.collect()))
    # No text of a customer's or a brand's file is shuffled, and each link is joined once.
    assert "LIMIT" not in corpus.source_files(spark, sf).where("path like 'src/%'")._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]


def test_usage_is_added_as_rows_stand_in_the_file_and_nulls_are_those_of_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quarry.catalog import ORACLE_SQL, QUERIES

    tokens = [0.1, 0.7, 0.2] * 30  # in this order 29.999999999999986, by falling ids 30
    rows = [(1, "t", x, k) for k, x in zip([*range(1, 90, 3), *range(0, 90, 3), *range(2, 90, 3)], sorted(tokens), strict=True)]
    rows = sorted(rows, key=lambda r: (r[3] % 7, -r[3]))
    rows += [(2, None, 5.0, 100), (2, "a", 2.5, 101), (2, "b", None, 102), (3, None, 1.0, 103), (4, "a", None, 104), (None, "a", 1.0, 105)]
    names = ("user_id", "event_type", "value", "event_id")
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLE_SQL["c25_usage_report"]).fetchall()
    assert sorted(map(str, map(tuple, QUERIES["c25_usage_report"](spark, str(tmp_path)).collect()))) == sorted(map(str, want))
