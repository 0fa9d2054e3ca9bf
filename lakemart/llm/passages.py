"""Removal of repeated passages, on lines of their own or inside lines.

A text is cut into short lines: after each line end, and after each word whose hash is 0 modulo
``EVERY``, so the cuts inside a passage do not hang on what stands around it.  Every two
neighbouring short lines are a chunk, keyed by a rolling hash over the lines' hashes; chunks
overlap, so all short lines of a repeated passage but the cut ones at its ends are in a repeated
chunk.  Repeated chunks are compared by their bytes (a key that stands for different bytes is
not used).  The first occurrence (by id, then the text's hash, then place) stays; runs of
consecutive other chunks go where they hold ``MIN_CHARS`` characters together.

Hot chunks are summed up in the map tasks.  Texts are shuffled once, by row; of the chunks only
keys, and the bytes of the repeated ones.

Defined results: null and empty texts have no lines and come back empty; a null id comes before
all others; rows are told apart by a key of their own, so of repeated rows one keeps its passages;
white space belongs to the line before it; a text without white space is one line and stays;
an empty table gives none; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, Words, blocks, hash_spans, mix, small_batches, staged, texts_of

MIN_CHARS = 100
#: A short line ends after about one word in so many.
EVERY = 5
INSIDE = np.ones(256, dtype=bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False


class Lines:
    """The short lines of a block of texts: byte offsets ``start`` and ``end`` into ``data``, the
    row ``doc``, and of each row the ``first`` line and their ``count``."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, INSIDE, lower=False)
        self.data, self.offsets = w.data, w.offsets
        ends = np.concatenate([[0], np.cumsum(w.data == 10)])
        same = w.doc[1:] == w.doc[:-1]
        cut = same & ((w.key[:-1] % np.uint64(EVERY) == 0) | (ends[w.start[1:]] > ends[w.end[:-1]]))
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins = np.zeros(len(self.data), dtype=bool)
        begins[filled] = begins[w.start[1:][cut]] = True
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], len(self.data))[:len(self.start)]
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.count = np.bincount(self.doc, minlength=len(texts))

    def points(self) -> np.ndarray:
        """The code points before each byte."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """The first line of each chunk, and its key."""
        h = hash_spans(self.data, self.start, self.end)
        at = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        return at, mix(h[at] * M1 + mix(h[at + 1])).view(np.int64)


def keys(base: DataFrame) -> DataFrame:
    """The ``key`` of each chunk, to be counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(Lines(texts_of(batch.column(0))).chunks()[1])], names=["key"])

    return base.select("text").mapInArrow(run, "key long")


def places(base: DataFrame) -> DataFrame:
    """Each chunk: its ``key``, the ``row`` and the number ``i`` of its first line there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            x = Lines(texts_of(batch.column(1)))
            at, key = x.chunks()
            d = x.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(d)), pa.array((at - x.first[d]).astype(np.int32))],
                                             names=["key", "row", "i"])

    return base.select("row", "text").mapInArrow(run, "key long, row long, i int")


def held_chunks(own: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The repeated chunks of a batch of rows: each one's row, the number of its first line there, its key, and
    whether it repeats an earlier one."""
    d = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
    x = own.flatten()
    i, key, later = (x.field(x.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("i", "key", "later"))
    return d, i.astype(np.int64), key, later


def texts_of_chunks(held: DataFrame) -> DataFrame:
    """``key`` and bytes ``t`` of each repeated chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 0):
            x = Lines(texts_of(batch.column(0)))
            d, i, key, _ = held_chunks(batch.column(1))
            at, data = x.first[d] + i, x.data.tobytes()
            out = [data[a:b] for a, b in zip(x.start[at].tolist(), x.end[at + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(out, pa.binary())], names=["key", "t"])

    return held.select("text", "own").mapInArrow(run, "key long, t binary")


def cut(text: bytes, start: np.ndarray, end: np.ndarray, points: np.ndarray, later: list[int]) -> tuple[bytes, int]:
    """What stays of a text, and how many lines go: ``later`` are the first lines of the chunks
    that repeat an earlier one, ascending."""
    kept, at, gone = [], 0, 0
    k = 0
    while k < len(later):
        j = k
        while j + 1 < len(later) and later[j + 1] == later[j] + 1:
            j += 1
        a, b = later[k], later[j] + 1
        if points[end[b]] - points[start[a]] >= MIN_CHARS:
            kept.append(text[at:start[a] - start[0]])
            at = int(end[b] - start[0])
            gone += b - a + 1
        k = j + 1
    kept.append(text[at:])
    return b"".join(kept), gone


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` without repeated passages, ``n_lines`` and ``n_removed``: how many
    short lines the text had, and how many of them were removed."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = staged(base.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")), "passage-texts")
    ids = base.select("id", "row", "h")
    # keys that occur twice, before anything else of the chunks is moved
    again = staged(keys(base).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "passage-keys")
    hits = staged(places(base).join(again, "key").join(ids, "row"), "passage-hits")
    first = hits.groupBy("key").agg(F.min(F.struct("id", "h", "row", "i")).alias("f")).select("key", F.col("f.row").alias("row0"), F.col("f.i").alias("i0"))
    hits = hits.join(first, "key").select("row", "key", "i", ((F.col("row") != F.col("row0")) | (F.col("i") != F.col("i0"))).alias("later"))
    hits = staged(hits, "passage-places")
    own = hits.groupBy("row").agg(F.collect_list(F.struct("i", "key", "later")).alias("own"))
    held = staged(base.join(own, "row", "left").select("id", "row", "text", "own"), "passage-rows")
    clash = texts_of_chunks(held.where("own is not null")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    bad = staged(hits.join(clash, "key").groupBy("row").agg(F.collect_set("key").alias("bad")), "passage-clashes")
    x = held.join(bad, "row", "left").select("id", "own", "bad", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 3):
            x = Lines(texts_of(batch.column(3)))
            points = x.points()
            out, gone = [], []
            own, i, key, later = held_chunks(batch.column(1))
            own, i, key = own[later], i[later], key[later]
            order = np.lexsort((i, own))
            own, i, key = own[order], i[order], key[order]
            bounds = np.searchsorted(own, np.arange(batch.num_rows + 1))
            for d, b in enumerate(batch.column(2).to_pylist()):
                text = x.data[x.offsets[d]:x.offsets[d + 1]].tobytes()
                mine = slice(int(bounds[d]), int(bounds[d + 1]))
                later = i[mine] if b is None else i[mine][~np.isin(key[mine], b)]
                lines = slice(int(x.first[d]), int(x.first[d] + x.count[d]))
                t, n = cut(text, x.start[lines], x.end[lines], points, later.tolist())
                out.append(t.decode())
                gone.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(x.count.astype(np.int64)), pa.array(gone, pa.int64())],
                                             names=["id", "text", "n_lines", "n_removed"])

    kind = base.schema["id"].dataType.simpleString()
    return x.mapInArrow(run, f"id {kind}, text string, n_lines long, n_removed long").select(F.col("id").alias(id_col), "n_lines", "n_removed", F.col("text").alias(text_col))
