"""Helpers that the corpus operators share: Arrow batches by bytes, a vectorised word
splitter, and written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Bytes of text that a task works on at once (a longer text is one block of its own).
BLOCK_BYTES = 4 << 20

UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32  # A-Z to a-z


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the cluster's shared ``spark.checkpoint.dir`` and
    read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = "/".join([checkpoint_dir(spark).rstrip("/"), "lakemart-llm", f"{name}-{uuid.uuid4().hex}"])
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the Arrow batches by rows; texts average kilobytes, not bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_text(df: DataFrame, kept: list[T.StructField], text_col: str) -> DataFrame:
    """The columns kept and, last, the text as a string, under a name that none of them has."""
    name = "text_"
    while any(f.name == name for f in kept):
        name += "_"
    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").cast("string").alias(name))


def texts_of(column) -> pa.Array:
    """A string column as one Arrow array without nulls (null: empty)."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(x, "")


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroup batches into ones of about ``limit`` bytes of text (in the column of that
    number): small ones are joined, large ones cut between rows."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined():
        t = pa.Table.from_batches(held).combine_chunks()
        return t.to_batches()[0] if t.num_rows else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 32  # an empty row has a size, too
        at = 0
        while at < len(n):
            upto = size + np.cumsum(n[at:])
            k = int(np.searchsorted(upto, limit, side="left")) + 1
            k = min(k, len(n) - at)
            held.append(batch.slice(at, k))
            size = int(upto[k - 1])
            at += k
            if size >= limit:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


class Words:
    """The words of a block of texts: maximal runs of bytes of a class.

    ``start`` and ``end`` are byte offsets into ``data`` (the texts end to end), ``doc`` is
    the row, ``count`` the words of each row, ``first`` the index of each row's first word,
    ``key`` a 64-bit hash of the word's bytes."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, lower: bool = True, hashed: bool = True):
        data, offsets = text_bytes(texts)
        if lower:
            data = UPPER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        word = inside[data]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = word
        before[offsets] = False  # a word ends with its text
        self.start = np.flatnonzero(word & ~before[:n])
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = word
        after[offsets] = False
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        bounds = np.append(self.first, len(self.start))
        self.count = np.diff(bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        if hashed:
            self.key = hash_spans(data, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the rows' offsets in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a step for all spans at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # the eight bytes from each position on as one little-endian number
    ahead = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    out = mix(length.astype(np.uint64) * M1)
    live, at, left = slice(None), start, length
    while len(at):
        spare = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
        out[live] = mix(out[live] * M1 + ((ahead[at] << spare) >> spare))
        keep = np.flatnonzero(left > 8)
        live = keep if isinstance(live, slice) else live[keep]
        at, left = at[keep] + 8, left[keep] - 8
    return out


def segment_sum(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of each run ``first[i] .. first[i]+count[i]``."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first + count] - total[first]


def doc_hash(*cols: str):
    """A stable order of rows that says nothing about their contents."""
    return F.xxhash64(F.lit(20240229), *[F.col(c) for c in cols])
