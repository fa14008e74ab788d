from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = "the quick brown fox jumps over the lazy dog near the river bank " * 3000

#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, and no letters.
ODD = [
    (0, None, "en", "a", None),
    (1, "", None, "a", 0),
    (2, "   \n\t", "en", None, 5),
    (3, "12 34 !!", "en", "b", 8),
    (4, LONG, "en", "b", len(LONG)),
    (4, LONG, "en", "b", len(LONG)),
    (5, "naïve café 日本語 😀 \x00 <|endoftext|> tail", "fr", "c", 30),
    (None, "a row without an id has words too", "en", "c", 33),
    (None, None, None, None, None),
    (7, "one", "en", "c", 3),
    (8, "one two", "en", "c", 7),
]


def docs(spark, rows, extra=None):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
    for name in extra or ():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(1))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
