import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
# Texts of the edge cases: null, empty, blank, ties, copies but for white space, junk, other scripts, very long ones.
TEXTS = [
    None, "", " \t\n", "a", "A", "a b", "a  b", "a b ", "the and of the thing", "the and of the thing", "THE and of the thing",
    "12 34 !!", "Ωμέγα και άλφα", "漢字 かな", "x" * 5000, "la de los las que " * 3000, "<|endoftext|> x <|endoftext|>", "\u0000 \U0001F600 ▁ ok",
    "mail a.b@c.de or +1 (741) 555-3069, card 4111 1111 1111 1111 at 1.2.3.4", "under the MIT license. Apache License, Version 2 cc-by-nc",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, ties, repeated rows and columns whose names the operators use themselves."""
    rows = [(i, text, [None, "en", "es"][i % 3]) for i, text in enumerate(TEXTS)] + [(3, "a", "en"), (3, "a", "en"), (None, "a b", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                       F.lit(1).alias("score"), F.lit(2).alias("h"), F.lit(3).alias("fp"), F.lit(4).alias("kept"), F.lit(None).cast("string").alias("spans"),
                       F.lit(5).alias("bucket"), F.lit(6).alias("vector"), F.lit(7).alias("component"), F.array(F.lit(1)).alias("ids"))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
