"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` reads the training texts once, splits them into shards (a few MB of text each)
and stores, for every term that a map of the items' terms holds, the ascending word positions
at which a shard holds it (one row per shard and term, written as a table in the shared
folder).  ``anchors`` finds each window's rarest term over all shards; a join on that term
sends the window to the shards that hold it, and ``located`` streams a shard's windows past
the shard's lists: from the rarest list on, offset-adjusted, for exact phrases; and, where
asked for, all terms of a window within a span of words, in any order.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; A-Z are
lower-cased.  Terms and windows are held as 64-bit hashes.  A task holds one shard's lists and
one batch of windows, however many items there are; no item passes through the driver.  The
map of terms has a fixed size (``TERM_BITS``): with very many items it fills up and the index
holds more terms than needed, the matches are the same.

Defined results: a null or empty text has no words and no match; a null or empty item has no
window; an item with a null id is searched for but not listed; repeated rows are judged each on
its own; repeated items under one id count once; an
empty table of items leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, small_batches, staged, texts_of

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: Words of a proximity match in the registered query.
NEAR = 15
#: Bits of the map of the items' terms: 8 MB.
TERM_BITS = 1 << 26

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

HEAD, LIST, ASKED = 0, 1, 2
INDEX = "shard string, kind int, term long, n long, postings binary, ids array<string>"
SPANS = "array<struct<start:int,end:int>>"
FOUND = f"place string, id string, n_words long, n_hit long, spans {SPANS}, n_near long, near_spans {SPANS}, wid long, exact boolean"


def item_windows(items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, terms): every window of every item, as term hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1, 1 << 20):
            w = Words(texts_of(b.column(1)), WORD)
            n = np.where(w.count > 0, np.maximum(w.count - window + 1, 1), 0)
            row = np.repeat(np.arange(len(n)), n)
            start = w.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(w.count[row], window)
            for k in range(0, len(row), 20_000):
                s, m = start[k:k + 20_000], size[k:k + 20_000]
                cuts = np.concatenate([[0], np.cumsum(m)])
                at = np.repeat(s - cuts[:-1], m) + np.arange(cuts[-1])
                terms = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(w.key[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[k:k + 20_000])), terms], names=["item", "terms"])

    return items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")) \
        .mapInArrow(run, "item string, terms array<long>")


def term_map(windows: DataFrame) -> np.ndarray:
    """A bitmap of ``TERM_BITS`` bits with one set for each term of the windows; at most
    ``TERM_BITS`` / 32768 rows of 4 KB reach the driver."""
    bit = windows.select(F.explode("terms").alias("term")).select(F.expr(f"pmod(term, {TERM_BITS}) + 1").alias("bit"))
    out = np.zeros(TERM_BITS // 8, np.uint8)
    for r in bit.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        part = np.frombuffer(r["bits"], np.uint8)
        first = (r["at"] - 1) * len(part)
        out[first:first + len(part)] |= part[:len(out) - first]
    return out


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray, gap: int) -> DataFrame:
    """Positional postings of the terms in the map, by shard.

    ``LIST`` rows hold a term's int32 positions, delta coded; the shard's ``HEAD`` row lists its
    documents and (as postings) their word counts.  Positions of successive documents of a shard
    lie ``gap`` apart, so that no match reaches from one into the next."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # TERM_BITS bits

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, known_bits = TaskContext.get().partitionId(), sent.value
        for seq, b in enumerate(blocks(batches, -1)):
            w = Words(texts_of(b.column(1)), WORD)
            bit = (w.key & np.uint64(TERM_BITS - 1)).astype(np.int64)
            known = np.flatnonzero((known_bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            term, number = np.unique(w.key[known], return_inverse=True)
            order = np.argsort(number, kind="stable")
            position = (known + w.doc[known] * gap)[order].astype(np.int32)
            size = np.bincount(number, minlength=len(term))
            lists = np.split(position, np.cumsum(size)[:-1]) if len(term) else []
            k = len(term)
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{part}-{seq}"] * (k + 1)),
                pa.array([HEAD, *[LIST] * k], pa.int32()),
                pa.array(np.concatenate([np.zeros(1, np.int64), term.view(np.int64)])),
                pa.array(np.concatenate([np.zeros(1, np.int64), size]), pa.int64()),
                pa.array([w.count.astype(np.int32).tobytes(), *(np.diff(x, prepend=np.int32(0)).tobytes() for x in lists)], pa.binary()),
                pa.array([b.column(0).to_pylist()] + [None] * k, pa.list_(pa.string())),
            ], names=["shard", "kind", "term", "n", "postings", "ids"])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(shards, INDEX)


def anchors(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Each distinct window (wid, terms) with its rarest term; windows with a term that no
    document holds are left out."""
    frequency = index.where(f"kind = {LIST}").groupBy("term").agg(F.sum("n").alias("n"))
    phrases = windows.select("wid", "terms").dropDuplicates(["wid"])
    rarest = phrases.select("wid", F.explode("terms").alias("term")).join(frequency, "term") \
        .groupBy("wid").agg(F.min(F.struct("n", "term"))["term"].alias("term"), F.count(F.lit(1)).alias("held"))
    return phrases.join(rarest, "wid").where("held = size(terms)").select("wid", "term", "terms")


def near_anchors(lists: list, span: int) -> np.ndarray:
    """Of the occurrences of the rarest term (the first list) those with every other term less
    than ``span`` words away."""
    found = lists[0]
    for own in lists[1:]:
        at = np.searchsorted(own, found)
        after = own[np.minimum(at, len(own) - 1)]
        before = own[np.maximum(at - 1, 0)]
        found = found[np.minimum(np.abs(after - found), np.abs(found - before)) < span]
        if not len(found):
            break
    return found


def phrase_places(lists: list, offsets: np.ndarray, found: np.ndarray) -> np.ndarray:
    """First positions of an exact phrase: from occurrences of its rarest term (the first list),
    shifted by its offset, through the shifted lists of the others."""
    found = found - offsets[0]
    for own, k in zip(lists[1:], offsets[1:], strict=True):
        if not len(found):
            break
        at = np.searchsorted(own, found + k)
        found = found[own[np.minimum(at, len(own) - 1)] == found + k]
    return found


def near_places(lists: list, rare: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans [start, end) of at most ``span`` words that hold all terms, in any order: from every
    occurrence of a term that has a rare one within reach to the furthest of the terms' next
    occurrences."""
    starts = np.unique(np.concatenate([own[_reach(own, rare, span)] for own in lists]))
    last = starts.copy()
    for own in lists:
        at = np.searchsorted(own, starts)
        last = np.maximum(last, np.where(at >= len(own), np.iinfo(np.int64).max >> 1, own[np.minimum(at, len(own) - 1)]))
    fits = last - starts < span
    return starts[fits], last[fits] + 1


def _reach(own: np.ndarray, rare: np.ndarray, span: int) -> np.ndarray:
    """Which of ``own`` lie less than ``span`` words before an occurrence of the rarest term."""
    at = np.searchsorted(rare, own)
    return np.flatnonzero((at < len(rare)) & (rare[np.minimum(at, len(rare) - 1)] - own < span))


class Spans:
    """Matches of a shard: distinct (start, length), so no more than words times lengths."""

    def __init__(self):
        self.code, self.new = np.zeros(0, np.int64), []

    def add(self, start: np.ndarray, end: np.ndarray) -> None:
        self.new.append((start.astype(np.int64) << 20) + (end - start))

    def fold(self) -> None:
        if self.new:
            self.code, self.new = np.unique(np.concatenate([self.code, *self.new])), []

    def by_document(self, first: np.ndarray, count: np.ndarray, gap: int) -> tuple[np.ndarray, pa.Array]:
        """Words of each document inside matches, and its matches."""
        self.fold()
        start, size = self.code >> 20, self.code & ((1 << 20) - 1)
        marks = np.zeros(int((count + gap).sum()) + 1, np.int32)
        np.add.at(marks, start, 1)
        np.add.at(marks, start + size, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
        doc = np.searchsorted(first, start, side="right") - 1
        own = start - first[doc]
        cuts = np.searchsorted(doc, np.arange(len(first) + 1))
        rows = pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(own + size, pa.int32())], names=["start", "end"])
        return inside[first + count] - inside[first], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows)


class Shard:
    """One shard's documents and lists; ``search`` takes its windows batch by batch."""

    def __init__(self, name: str, gap: int, span: int | None):
        self.name, self.gap, self.span = name, gap, span
        self.ids, self.count = [], np.zeros(0, np.int64)
        self.held: dict[int, np.ndarray] = {}
        self.terms = None
        self.exact, self.near = Spans(), Spans()

    def seal(self) -> None:
        self.terms = np.array(sorted(self.held), np.int64)
        self.lists = [self.held[t] for t in self.terms.tolist()]
        self.held = {}
        self.first = np.concatenate([[0], np.cumsum(self.count + self.gap)[:-1]]) if len(self.count) else np.zeros(0, np.int64)

    def search(self, wids: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        """Pairs of a document and a window that it holds (``exact``: as a phrase)."""
        if self.terms is None:
            self.seal()
        at = np.minimum(np.searchsorted(self.terms, flat), max(len(self.terms) - 1, 0))
        here = np.logical_and.reduceat(self.terms[at] == flat, cuts[:-1]) if len(self.terms) else np.zeros(len(wids), bool)
        pairs: list[tuple[np.ndarray, int, bool]] = []
        for k in np.flatnonzero(here):
            own = at[cuts[k]:cuts[k + 1]]
            order = sorted(range(len(own)), key=lambda j: len(self.lists[own[j]]))
            lists = [self.lists[own[j]] for j in order]
            found = lists[0]
            if self.span is not None:
                found = near_anchors(lists, max(self.span, len(own)))
                if len(found):
                    start, end = near_places(lists, found, self.span)
                    self.near.add(start, end)
                    pairs.append((start, k, False))
            if len(found):
                start = phrase_places(lists, np.array(order), found)
                if len(start):
                    self.exact.add(start, start + len(own))
                    pairs.append((start, k, True))
        self.exact.fold()
        self.near.fold()
        place, wid, kind = [], [], []
        for start, k, exact in pairs:
            docs = np.unique(np.searchsorted(self.first, start, side="right") - 1)
            place += [f"{self.name}-{d}" for d in docs]
            wid += [int(wids[k])] * len(docs)
            kind += [exact] * len(docs)
        return _found(len(place), place=place, wid=wid, exact=kind)

    def documents(self) -> pa.RecordBatch:
        if self.terms is None:
            self.seal()
        n_hit, spans = self.exact.by_document(self.first, self.count, self.gap)
        n_near, near_spans = self.near.by_document(self.first, self.count, self.gap)
        n = len(self.ids)
        return _found(n, place=[f"{self.name}-{d}" for d in range(n)], id=self.ids, n_words=self.count, n_hit=n_hit, spans=spans,
                      n_near=n_near, near_spans=near_spans)


PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
COLUMNS = {"place": pa.string(), "id": pa.string(), "n_words": pa.int64(), "n_hit": pa.int64(), "spans": PAIRS,
           "n_near": pa.int64(), "near_spans": PAIRS, "wid": pa.int64(), "exact": pa.bool_()}


def _found(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c not in columns else columns[c].cast(t) if isinstance(columns[c], pa.Array)
                                       else pa.array(columns[c], t) for c, t in COLUMNS.items()], names=list(COLUMNS))


def _search(gap: int, span: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            if not b.num_rows:
                continue
            names, kind = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            new = np.concatenate([[True], (names[1:] != names[:-1]) | (kind[1:] != kind[:-1])])
            for s, e in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], b.num_rows), strict=True):
                if shard is None or shard.name != names[s]:
                    if shard is not None:
                        yield shard.documents()
                    shard = Shard(names[s], gap, span)
                run_ = b.slice(s, e - s)
                if kind[s] == HEAD:
                    shard.ids = run_.column(4)[0].as_py()
                    shard.count = np.frombuffer(run_.column(3)[0].as_py(), np.int32).astype(np.int64)
                elif kind[s] == LIST:
                    for t, x in zip(run_.column(2).to_pylist(), run_.column(3), strict=True):
                        shard.held[t] = np.cumsum(np.frombuffer(x.as_buffer(), np.int32), dtype=np.int64)
                else:
                    lists = run_.column(5)
                    flat = lists.flatten().to_numpy()
                    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    yield shard.search(run_.column(2).to_numpy(), flat, cuts)
        if shard is not None:
            yield shard.documents()

    return run


def located(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, gap: int, span: int | None) -> DataFrame:
    """A written table with a row per document (``wid`` null: words, words inside matches, the
    matches) and a row per document and window that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    index = staged(build_index(docs, id_col, text_col, term_map(windows), gap), "postings")
    sought = staged(anchors(index, windows), "anchors")
    asked = index.where(f"kind = {LIST}").select("shard", "term").join(sought, "term").select(
        "shard", F.lit(ASKED).alias("kind"), F.col("wid").alias("term"), F.lit(None).cast("binary").alias("postings"),
        F.lit(None).cast("array<string>").alias("ids"), "terms")
    rows = index.select("shard", "kind", "term", "postings", "ids", F.lit(None).cast("array<long>").alias("terms")).unionByName(asked)
    return staged(rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(gap, span), FOUND), "found")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  proximity: int | None = None) -> DataFrame:
    """Match every document against every window of every item.

    Columns: ``id_col``, ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted), ``spans``
    (matches as word offsets, end exclusive).  ``proximity``: a number of words; windows then
    match where all their terms lie within so many words."""
    found = matches(docs, items, id_col, text_col, item_id, item_text, window, proximity)
    if proximity is not None:
        found = found.select(id_col, "n_words", F.col("n_near").alias("n_hit"), F.col("near_items").alias("items"), F.col("near_spans").alias("spans"))
    return found.select(id_col, "n_words", "n_hit", "items", "spans")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, proximity: int | None = None) -> DataFrame:
    """``contamination`` with exact and proximity matches side by side: ``n_hit``, ``items``,
    ``spans`` and ``n_near``, ``near_items``, ``near_spans`` (0 and empty without ``proximity``)."""
    if proximity is not None and not 0 < proximity < 1 << 20:
        raise ValueError("proximity is a number of words below 2^20")
    gap = max(window, proximity or 0) + 1
    kind = docs.schema[id_col].dataType
    windows = staged(item_windows(items, item_id, item_text, window).withColumn("wid", F.xxhash64("terms")).distinct(), "windows")
    found = located(docs, windows, id_col, text_col, gap, proximity)
    # the items that hold a window, once per document; a frequent window's rows are joined and summed up in parts
    held = found.where("wid is not null").select("place", "wid", "exact").join(windows.select("wid", "item"), "wid") \
        .groupBy("place", "item").agg(F.max("exact").alias("exact"), F.max(~F.col("exact")).alias("near"))
    held = held.groupBy("place").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"),
                                     F.array_sort(F.collect_list(F.when(F.col("near"), F.col("item")))).alias("near_items"))
    none = F.array().cast("array<string>")
    return found.where("wid is null").drop("wid", "exact").join(held, "place", "left").select(
        F.col("id").cast(kind).alias(id_col), "n_words", "n_hit", F.coalesce("items", none).alias("items"), "spans",
        "n_near", F.coalesce("near_items", none).alias("near_items"), "near_spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the rows of ``matches``, and those of the proximity matches."""
    def sha(c):
        return F.sha2(F.concat_ws(",", c), 256)

    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha("items").alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near", F.size("near_items").cast("long").alias("n_near_items"),
                        sha("near_items").alias("near_items_sha256"))
