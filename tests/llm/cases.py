"""Hand-made documents with the awkward cases: nulls in any column, empty and very long
texts, ties, repeated rows, and columns whose names clash with those of the operators."""

from __future__ import annotations

WORDS = "the of and thing erlich oument queda red tion ander miteau sola ver pre lon gra".split()


def prose(seed: int, n: int, step: int = 12) -> str:
    """Fixed pseudo-random sentences."""
    x, out = seed * 7919 + 13, []
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        w = WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)] * ((x >> 3) % 2)
        out.append(w + (". " if k % step == step - 1 else ".\n" if k % (3 * step) == 3 * step - 2 else " "))
    return "".join(out).strip()


ROWS = [
    (1, prose(1, 120), "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "de", "b"),
    (5, prose(1, 120), "en", "a"),  # an exact copy
    (6, prose(1, 120).replace("the", "thee", 1), "en", "a"),  # a near copy
    (7, prose(7, 30000), "fr", "hot"),  # very long
    (8, "one", None, "hot"), (9, "a b", "en", None), (10, "123 !!! ...", "en", "hot"), (11, prose(11, 400), "de", "hot"),
    (11, prose(11, 400), "de", "hot"),  # a repeated row
    (None, prose(12, 60), "en", "hot"), (13, "Ünïcödé ΣΣ İ ½ ² 中文 \U0001f44d <|endoftext|> x", "es", "a"),
    (14, "x" * 5000, "en", "a"), (15, prose(11, 400), "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASHES = ["id", "key", "score", "predicted", "n_words", "range", "ghost", "family", "lines", "chunks", "found", "spans", "ids", "__text", "gone", "e", "row"]


def documents(spark, rows=None):
    from pyspark.sql import functions as F
    x = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return x.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def empty(spark):
    return documents(spark, [])
