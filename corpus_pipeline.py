"""From raw documents to packed training windows: five stages, each one operator of layerloom.llm.

Every stage reads what its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.llm import decontamination, packing, quality_rules, simhash, suffix_dedup
from layerloom.llm.common import stored
from layerloom.llm.queries import tokenizer_path
from layerloom.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return quality_rules.apply_policy(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates: by SimHash, or by five-word shingles at 0.8."""
    return simhash.keep_one(docs, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 100 earlier bytes; a document that loses all its words goes."""
    cut = suffix_dedup.deduplicate(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text)
    return new.where((F.col("n_removed") == 0) | F.col("text").rlike("[^ \\x09-\\x0D]")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


def _ready(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _ready(keep_quality)),
    ("simhash_near_dedup", _ready(drop_near_duplicates)),
    ("suffix_dedup", _ready(cut_repeats)),
    ("decontamination", _ready(drop_contaminated)),
    ("packing", _ready(pack_windows)),
]

#: SimHash, suffix order and tokenization cannot be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
