import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("row", StringType()), StructField("id", StringType())])


def sentence(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty and long texts, copies, near copies and shared passages."""
    rng = random.Random(7)
    passage = sentence(rng, 60)
    texts = [sentence(rng, rng.randint(1, 200)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " Tail"]
    texts += [f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}" for _ in range(6)]
    near = texts[7].split(" ")
    texts += [" ".join([*near[:-1], "other"]), None, "", " \t\n", "aa " * 400, "é" * 300 + "è",
              "x" * 150 + "é" * 120, "Ünïcödé wörds " * 20, sentence(rng, 6000)]
    rows = list(enumerate(texts))
    rows += [(None, texts[0]), (None, None), (2, texts[2])]  # null ids, a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    rows = [(d, t, "r", "i") for d, t in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
