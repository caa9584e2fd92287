"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes all rows its predecessor kept and calls one operator; ``run`` writes what a stage
returns and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfield.llm.decontaminate import without_matches
from ledgerfield.llm.packing import pack
from ledgerfield.llm.quality import keep_good
from ledgerfield.llm.repeats import remove_repeats
from ledgerfield.llm.simhash import keep_one
from ledgerfield.llm.tables import table, written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints stays."""
    return keep_one(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out; every document stays."""
    out = remove_repeats(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark appears go."""
    return without_matches(spark, docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; one row per piece."""
    return pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The stages' fingerprints, suffix order, edit distance and packing cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
