import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest scale, as rows and as a table."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    return table.collect(), table


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and near copies."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base = prose(120)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "b", None), (2, base, "en", "b", None), (3, base.replace("w1 ", "zz "), None, None, 3)]
    rows += [(4, None, "en", "a", 0), (None, prose(40), "en", "a", 5), (None, None, None, None, None), (5, "", "en", "c", 0), (6, " \t\n ", "en", "c", 3)]
    rows += [(7, prose(9000), "en", "a", 0), (8, "İstanbul ß é x\u0085y  <|endoftext|> 日本", "xx", "d", 1), (9, "\n".join([prose(12)] * 3 + [prose(30)]), "en", "a", 9)]
    rows += [(10, "same words here", "en", "a", 1), (11, "same words here", "en", "a", 1), (10, "another text for ten", "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash(spark, odd):
    """The odd rows with more columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    out = odd[1]
    for name in ("size", "shard", "fp", "Gone", "kept", "kept_id", "mix_id", "d", "t", "h", "length", "words", "removal_d", "mix_position"):
        out = out.withColumn(name, F.lit("x"))
    return out
