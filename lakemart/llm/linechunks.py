"""Removal of repeated multi-line chunks (DataFrame functions only).

A text is read as lines: cut after each line end and, so that a passage inside one long line
has lines too, after each full stop and space.  Every line is hashed; a rolling hash over two
neighbouring line hashes decides, from the lines' own contents, where a chunk ends (so text
put in front of a passage shifts nothing inside it).  Chunks of at least two lines and
``MIN_CHARS`` characters are grouped by digest over all documents, and where all texts of a
digest are the same bytes, every occurrence but the first (by id, then place) is removed.

Hot chunks are summed up in the map tasks: the grouping sends one row per chunk and task.

Defined results: null and empty texts have no lines and come back empty; a null id comes
before all others; rows that share an id and hold a chunk at the same place count as one place
(all keep or all lose it); single lines are never removed, however often they repeat; an
empty table gives none; other columns are not read.  The pair U+0001 U+0002 marks cuts and is
dropped from texts that lose a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk that may be removed, at least.
MIN_CHARS = 100
#: A chunk ends after about one line in so many.
MODULUS = 3
CUT = "\x01\x02"


def lines(text: Column) -> Column:
    """The lines of a text, each with the end that closes it."""
    marked = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\n" + CUT)), F.lit(". "), F.lit(". " + CUT))
    return F.filter(F.split(marked, CUT), lambda x: x != "")


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _before(x: Column, first: Column) -> Column:
    """An array moved on by one, from ``first``."""
    return F.slice(F.concat(F.array(first), x), F.lit(1), F.size(x))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A computed array as a column of its own.  Through ``explode`` of a one-element array,
    since the optimizer would put the expression into each lambda that refers to it, to be
    evaluated for every element."""
    return df.withColumn(name, F.explode(F.array(value)))


def chunked(docs: DataFrame, text: Column) -> DataFrame:
    """Append ``lines`` and ``chunks``: of each chunk its first line ``s`` (from 1), number of
    lines ``n``, and text ``t``; both null where ``text`` is."""
    x = _held(docs, "lines", F.when(text.isNotNull(), lines(text)))
    x = _held(x, "h", F.transform("lines", line_hash))
    x = _held(x, "c", F.zip_with("h", _before(F.col("h"), F.lit(0).cast("long")), lambda a, b: (a + 31 * b) % MODULUS == 0))
    # a line that ends a chunk right after another one that does would be a chunk alone
    x = _held(x, "e", F.filter(F.transform(F.zip_with("c", _before(F.col("c"), F.lit(False)), lambda a, b: a & ~b),
                                           lambda v, i: F.when(v | (i == F.size("lines") - 1), i + 1)), lambda v: v.isNotNull()))
    spans = F.zip_with(_before(F.col("e"), F.lit(0)), F.col("e"), lambda a, b: F.struct((a + 1).alias("s"), (b - a).alias("n")))
    x = _held(x, "spans", spans)
    chunks = F.transform("spans", lambda p: F.struct(p["s"].alias("s"), p["n"].alias("n"), F.array_join(F.slice("lines", p["s"], p["n"]), "").alias("t")))
    return _held(x, "chunks", chunks).drop("h", "c", "e", "spans")


def repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per id the chunks to be removed: ``gone``, an array of (first line, digest)."""
    x = chunked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text"))
    rows = x.select("id", F.explode("chunks").alias("c")).where((F.col("c.n") >= 2) & (F.length("c.t") >= MIN_CHARS)) \
        .select("id", F.col("c.s").alias("s"), F.md5("c.t").alias("digest"), F.col("c.t").alias("t"))
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "s")).alias("first"),
                                        F.min("t").alias("low"), F.max("t").alias("high"))
    known = groups.where((F.col("n") > 1) & (F.col("low") == F.col("high"))).select("digest", "first")
    return rows.select("id", "s", "digest").join(known, "digest").where(~F.struct("id", "s").eqNullSafe(F.col("first"))) \
        .groupBy("id").agg(F.collect_set(F.struct("s", "digest")).alias("gone"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """The documents with repeated chunks removed from ``text_col``, and ``lines_col`` and
    ``removed_col``: how many lines the text had, and how many of them were removed.  Input
    columns of these names are replaced."""
    gone = repeats(docs, id_col, text_col).select(F.col("id").alias("gone_id"), "gone")
    kept = [c for c in docs.columns if c not in (lines_col, removed_col)]
    # the input's columns under names of their own: none can clash with the names used here
    own = {c: f"in_{k}" for k, c in enumerate(kept)}
    x = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in kept]) \
        .join(gone, F.col(own[id_col]).eqNullSafe(F.col("gone_id")), "left")
    text = F.coalesce(F.col(own[text_col]), F.lit(""))
    x = chunked(x, F.when(F.col("gone").isNotNull(), text))  # only texts that lose a chunk are cut again
    x = _held(x, "stays", F.filter("chunks", lambda c: ~F.array_contains(F.col("gone"), F.struct(c["s"].alias("s"), F.md5(c["t"]).alias("digest")))))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("stays", lambda c: c["t"]), ""))
    n_lines = F.when(F.col("gone").isNull(), F.size(lines(text))).otherwise(F.size("lines")).cast("long")
    count = F.aggregate("stays", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return x.select(*[(left if c == text_col else F.col(own[c])).alias(c) for c in kept], n_lines.alias(lines_col),
                    F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(F.size("lines") - count).alias(removed_col))
