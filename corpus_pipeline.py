"""From raw documents to token ids: the corpus operators as a pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  Between stages the documents are written as Parquet and read again,
so a lost executor costs at most one stage's tasks.

* quality: documents that the classifier (fitted on the labelled ones among them) rejects go;
* line_dedup: repeated multi-line chunks are cut out of the texts, ``n_chars`` follows;
* near_duplicates: of the documents that links (five-word n-grams, Jaccard 0.8) connect, the
  one with the smallest id stays (a null id comes after all others; of rows of one id, one);
* decontamination: documents that hold ten consecutive words of a benchmark item go;
* encoding: the texts' token ids, with digests of ids and decoded text.

Defined results: every decision is a row's own, whatever its id: rows with a null id or with the
id of another row are scored, cut, linked and matched by their own text.  Repeated rows are near
duplicates of one another, so one stays; without words they link with nothing and stay, with no
tokens.  A null text counts as an empty one and is returned as it is by all stages but line_dedup,
which returns the empty text.  Other columns are dropped by the first stage.  An empty table gives
an empty one (without labels the classifier rejects nothing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.llm import bpe, decontam, linechunks, quality, sigtree
from lakemart.llm.common import staged
from lakemart.session import configure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: words of an n-gram, and Jaccard similarity in per cent.
WORDS, SIMILAR = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linechunks.remove(docs, "doc_id", "text", "__lines", "__removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _by_row(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a number of each row's own, written, so that it stays the same: decisions go by row, not by an id
    that may be null or repeated."""
    return staged(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), name)


def _without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    return rows.join(staged(gone.select("row"), name), "row", "left_anti").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _by_row(docs, "near_duplicate_rows")
    groups = sigtree.join(rows, n=WORDS, num=SIMILAR, den=100, id_col="row").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    kept = groups.groupBy("component_id").agg(first.alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", "kept")
    return _without(rows, groups.join(kept, "component_id").where("row <> kept"), "duplicates")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _by_row(docs, "decontamination_rows")
    found = decontam.contamination(rows, _table(spark, sf_dir, "benchmark"), id_col="row")
    return _without(rows, found.where("n_hit > 0"), "contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded=False).drop("text")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("encoding", encode),
]

#: No SQL states a trained classifier and a tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table; each stage's result is a written table."""
    configure(spark)
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
