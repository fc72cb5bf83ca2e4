"""The corpus pipeline: each stage works on all that its predecessor kept.

Cases that all stages but the last define alike: a null text counts as empty; an empty table gives no
rows and the columns of ``docs``; columns beyond those of ``documents`` pass through, whatever their
names; a row with a null id is kept unless its text is what makes it go; rows that repeat, and texts of
any length, are judged whole and alike. What a stage writes for itself is deleted once its rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, minhash, packing, quality, substring
from tessera.session import materialise, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the quality classifier rejects go.

    An empty text scores what the model gives without features; with labels of one class or none
    every score is that class's, or one half, and half is rejected too.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents whose five-word shingles are alike to 0.8 or more, one stays.

    It is the one with the smallest id. Empty texts are like nothing and stay; rows that share an id
    are one document and stay or go together.
    """
    return minhash.drop_near_duplicates(docs, shingle=5)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: words of passages of 50 words or more that stand in an earlier document go.

    A document of which nothing is left goes; texts that lose nothing stay as they are.
    """
    return substring.drop_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: contaminated documents go, single benchmark passages are cut out of the others.

    Null and empty texts hold nothing and stay; with an empty benchmark all stays.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what is left, packed into sequences.

    A null or empty text is a piece of the end mark alone; other columns aren't read.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Training and tokenizing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
