"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing names."""

LONG = " ".join(f"word{i % 977} of the {i % 13}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of strange herbs and sing"

TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " again"), (4, BASE.upper()), (5, ""), (6, None), (7, "   \n\t "),
    (8, "one two three"), (9, "one two three"), (10, "ONE two"), (11, LONG), (12, "a" * 3000), (13, "naïve Straße 東京 🙂 don't 1234 ##"),
    (14, "x\x1cy\x85z\xa0w"), (None, BASE), (None, None), (15, "only here"), (15, "only here"), (16, "<|endoftext|> stays text"),
]

#: Columns that operators use inside or return, as input columns of the documents.
CLASH = ["id", "n", "cls", "score", "tokens", "batch", "key", "label", "toxicity_score", "quality_key", "quality_ngrams"]


def docs(spark, rows=TEXTS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.concat(F.lit("src"), F.col("doc_id") % 3),
                         "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(7) for c in CLASH})
