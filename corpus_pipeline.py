"""From raw documents to packed training sequences.

Each stage reads what the stage before it kept, written as Parquet and read again; all but
the last return the columns of ``documents``, extra columns of any name included.  SQL cannot
express the stages, so the pipeline is tested against a brute-force version.

In every stage a null text counts as empty, an id may be null or repeat, texts of any length
are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, drop_rows, keep_rows, materialize, scratch
from quarry.llm.decontaminate import contamination
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.near_dedup import near_duplicates
from quarry.llm.packing import pack_documents
from quarry.llm.toxicity import keep_clean

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Empty texts stay; equal texts stay or go together; without labels of both kinds all stay.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id.

    Empty and null texts are equal.  Of rows that share that doc_id too, one stays; a row
    without an id stays only where its text has no other.
    """
    found = exact_dedup(docs).select("text_sha256", "row", "kept")
    # Rows that share the kept identifier but differ in letter case: one of them stays.
    several = found.where("kept").groupBy("text_sha256").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last")
    also = found.where("kept").join(several, "text_sha256").where("row <> first").select("row", F.lit(False).alias("kept"))
    decided = found.select("row", "kept").join(also.select("row"), "row", "left_anti").unionByName(also)
    return keep_rows(docs, decided)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the least doc_id.

    Texts without a word are alone in their class; of rows with one id and text one stays.
    """
    return keep_rows(docs, near_duplicates(docs).select("row", "kept"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go.

    Texts and items without a word never meet; without items all stay.
    """
    return drop_rows(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("row"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, one row per piece of a document.

    An empty text is its end id alone; rows that share an id are packed apart.
    """
    import public_tokenizers

    # A smaller cache than the operator's own: workers still hold memory of the stages before.
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cached_chunks=200_000)


def _stage(f: Stage) -> Stage:
    """A stage's tables go when the next stage begins: by then what it returned is stored."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark, "pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _stage(toxicity)),
    ("exact_duplicates", _stage(exact_duplicates)),
    ("near_duplicates", _stage(near_duplicate_groups)),
    ("benchmark_leaks", _stage(benchmark_leaks)),
    ("packing", _stage(packing)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs
