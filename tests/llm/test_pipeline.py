import corpus_pipeline as cp
from pyspark.sql import functions as F

from quarry.llm.common import drop_rows, keep_rows, row_hash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_exact_stage_keeps_one_row_of_each_text(spark):
    d = docs(spark, [(1, "Some text here"), (2, "some TEXT here"), (2, "some TEXT here"), (2, "SOME text here"), (3, None), (4, ""), (None, "alone"), (5, "other")])
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in cp.exact_duplicates(spark, d, "").collect())
    assert got == [("2", "some text here"), ("4", ""), ("5", "other"), ("None", "alone")]


def test_near_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(60))
    d = docs(spark, [(7, base), (3, base + " tail"), (9, base.replace("word5 ", "other ")), (4, "nothing like it at all, really"), (5, ""), (6, None)])
    got = sorted(r.doc_id for r in cp.near_duplicate_groups(spark, d, "").collect())
    assert got == [3, 4, 5, 6]


def test_drop_and_keep_rows_with_clashing_columns(spark):
    d = docs(spark, [(1, "a"), (1, "a"), (2, "b"), (3, "c")]).withColumn("_row", F.lit(1)).withColumn("row", F.lit("x"))
    gone = d.where("doc_id = 2").select(row_hash().alias("row"))
    assert sorted(r.doc_id for r in drop_rows(d, gone).collect()) == [1, 1, 3]
    decided = d.select(row_hash().alias("row"), (F.col("doc_id") != 3).alias("kept"))
    kept = keep_rows(d, decided)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert drop_rows(d.limit(0), gone).count() == 0


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "same text as that"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "x" * 60_000), (4, "same text as that"), (4, "same text as that"), (5, "word " * 9000)]
    odd = docs(spark, rows)
    for c in ("row", "_row", "key", "kept", "_text", "digest"):
        odd = odd.withColumn(c, F.lit("other"))
    left = {"toxicity": 8, "exact_duplicates": 5, "near_duplicates": 7, "benchmark_leaks": 6}
    for name, stage in cp.STAGES:
        got = stage(spark, odd, str(tmp_path))
        if name == "packing":
            assert got.where("piece = 0").count() == len(rows)
        else:
            assert got.columns == odd.columns and got.count() == left[name], name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_run_equals_brute_force(spark, tmp_path):
    import random

    rng = random.Random(41)
    text = lambda n: " ".join(f"t{rng.randrange(900)}" for _ in range(n))
    sentences = lambda n: ". ".join(text(8) for _ in range(n))
    items = [(k, text(40)) for k in range(5)]
    rows = [(k, sentences(rng.randrange(4, 20))) for k in range(300)]
    toxic = {k for k in range(300) if k % 6 == 0}
    rows = [(k, t + ". you vileword and crudword person" if k in toxic else t) for k, t in rows]
    by_id = dict(rows)
    rows += [(400 + k, by_id[7 + 6 * k].upper()) for k in range(10)]  # exact copies: the larger id stays
    rows += [(500 + k, by_id[8 + 6 * k] + " tail") for k in range(10)]  # near copies: the smaller id stays
    rows += [(600 + k, sentences(4) + " " + items[k][1] + " " + text(9)) for k in range(5)]
    labels = [(k, 1, int(k in toxic)) for k in range(300)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = ({k for k, _ in rows} - toxic - {7 + 6 * k for k in range(10)} - {500 + k for k in range(10)}) - {600 + k for k in range(5)}
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == want
    for seq in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
