"""Ranked lexical search by pipelined term partitioning.

1. ``index``: the documents are cut into shards (about ``BLOCK_BYTES`` of text, at most ``SHARD_DOCS`` rows).  A row of
   the written index holds a shard's posting list of one term (places in the shard, occurrences), or, without a term, the
   shard's document ids and lengths.  Only terms that some item holds are kept: a bitmap of hashed terms of fixed size
   (``MOST_BITS``, 1 MB) is sent to the tasks, and what collides in it falls out at the join with the items' terms.
2. Every term has an owner: the stage of its class of document frequency (``OWNERS``), rare terms first.  Items are dealt
   into parts of about ``PART_ITEMS``.
3. A bundle (shard, part) carries the items' sparse document accumulators.  It passes the owners one after the other: each
   stage cogroups the bundles with the owner's posting lists of that shard and part and adds integer contributions.  After
   a stage the ten highest partial scores of each item over all shards give a bound that its final tenth can't fall below;
   an accumulator whose score and the most that later owners can add stay below it is dropped.
4. The last owner leaves each shard's ten best documents of an item, from which the ten best of all are selected.

A group never holds more than a shard's documents and a part's items.  Terms are compared by 64-bit hashes.

Defined results: a null or empty text has no terms, as a document (never ranked; it isn't counted in N) and as an item (no
rows); every row of ``documents`` is a document of its own, also one that repeats another; a null document id comes after
all others of equal score; rows of one item id are one item, with the terms of all its distinct texts (a repeated row
counts once); a null item id is an item like others; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, blocks, mix, small_batches, staged, texts_of

TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Documents ranked for each item.
TOP = 10
#: Shares of the documents up to which a term belongs to the first, second, ... owner; the last owns the rest.
OWNERS = (1 / 512, 1 / 64, 1 / 8)
#: Documents of a shard at most, and items of a part on average.
SHARD_DOCS, PART_ITEMS = 4096, 256
#: Bits of the map of the items' terms.
MOST_BITS = 1 << 23

INDEX = "shard long, term long, count long, total long, most_tf long, least_n long, places binary, numbers binary, ids array<long>"
BUNDLE = "shard long, part int, m binary, ids array<long>, item binary, doc binary, score binary, tops array<struct<item: int, score: long>>"
FOUND = "part int, item int, doc_id long, score long"


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Each item's terms and how often it holds them: ``item_id, term, q``."""
    small_batches(items.sparkSession)
    x = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    kind = x.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, -1):
            w = Words(texts_of(b.column(1)), TERM)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(w.doc)), pa.array(w.key.view(np.int64))], names=["item_id", "term"])

    return x.mapInArrow(run, f"item_id {kind}, term long").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def _place(term: np.ndarray, bits: int) -> np.ndarray:
    return (mix(term.view(np.uint64)) >> np.uint64(20)).astype(np.int64) & (bits - 1)


def term_map(terms: DataFrame) -> np.ndarray:
    """A bitmap of hashed terms, at most ``MOST_BITS``: each task ORs its own, the driver ORs those of a few partitions."""
    bits = MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for b in batches:
            own[_place(b.column(0).to_numpy(), bits)] = True
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["m"])

    held = np.zeros(bits // 8, np.uint8)
    for r in terms.select("term").distinct().coalesce(4).mapInArrow(run, "m binary").collect():
        held |= np.frombuffer(r["m"], np.uint8)
    return np.unpackbits(held).astype(bool)


def index(docs: DataFrame, held: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Posting lists of the terms in the bitmap ``held``, and (term null) the shards' documents: ``count`` and ``total``
    are a list's documents, or the shard's documents with a term and its terms."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(held))  # MOST_BITS
    bits = len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).astype(bool)
        shard = TaskContext.get().partitionId() << 32
        for b in blocks(batches, -1):
            for at in range(0, b.num_rows, SHARD_DOCS):
                x = b.slice(at, SHARD_DOCS)
                w = Words(texts_of(x.column(1)), TERM)
                own = np.flatnonzero(known[_place(w.key, bits)])
                order = own[np.lexsort((w.doc[own], w.key[own]))]
                term, doc = w.key[order].view(np.int64), w.doc[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.append(first, len(order)))
                term, doc = term[first], doc[first].astype(np.int32)
                start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
                size = np.diff(np.append(start, len(term)))
                end = start + size
                lists = len(start)
                n = w.count.astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(lists + 1, shard)),
                    pa.array([None, *term[start].tolist()], pa.int64()),
                    pa.array(np.append(int((n > 0).sum()), size)),
                    pa.array(np.append(int(n.sum()), np.zeros(lists, np.int64))),
                    pa.array(np.append(0, np.maximum.reduceat(tf, start) if lists else tf)),
                    pa.array(np.append(0, np.minimum.reduceat(n[doc], start) if lists else tf)),
                    pa.array([b"", *(doc[a:z].tobytes() for a, z in zip(start, end, strict=True))], pa.binary()),
                    pa.array([n.tobytes(), *(tf[a:z].astype(np.int32).tobytes() for a, z in zip(start, end, strict=True))], pa.binary()),
                    pa.array([x.column(0).to_pylist(), *[None] * lists], pa.list_(pa.int64()))], names=[c.split()[0] for c in INDEX.split(", ")])
                shard += 1

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX)


def _best(score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Places of the ``TOP`` highest scores above 0; equal ones by id, null ids last."""
    at = np.flatnonzero(score > 0)
    if len(at) > TOP:
        least = np.partition(score[at], len(at) - TOP)[len(at) - TOP]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], none[at], -score[at]))][:TOP]


def _stage(last: bool):
    """What an owner does with a bundle and its posting lists."""
    def run(bundle: pa.Table, lists: pa.Table) -> pa.Table:
        if not bundle.num_rows:  # no shard without a bundle
            return bundle.slice(0, 0) if not last else pa.table({"part": [], "item": [], "doc_id": [], "score": []})
        b = bundle.to_pylist()[0]
        m = np.frombuffer(b["m"], np.int64)
        rest, bound = np.array(b["rest"], np.int64), np.array(b["bound"], np.int64)
        acc = np.zeros((len(rest), len(m)), np.int64)
        acc[np.frombuffer(b["item"], np.int32), np.frombuffer(b["doc"], np.int32)] = np.frombuffer(b["score"], np.int64)
        for places, numbers, items, weights in zip(*(lists.column(c) for c in ("places", "numbers", "items", "weights")), strict=True):
            doc, tf = np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(numbers.as_buffer(), np.int32).astype(np.int64)
            got = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            for i, w in zip(items.as_py(), weights.as_py(), strict=True):
                acc[i, doc] += w * got
        none = np.array([x is None for x in b["ids"]], dtype=bool)
        ids = np.array([0 if x is None else x for x in b["ids"]], np.int64)
        tops = [(i, at) for i in range(len(rest)) for at in [_best(acc[i], ids, none)] if len(at)]
        if last:
            item = [i for i, at in tops for _ in at]
            return pa.table({"part": pa.array([b["part"]] * len(item), pa.int32()), "item": pa.array(item, pa.int32()),
                             "doc_id": pa.array([b["ids"][k] for _, at in tops for k in at], pa.int64()),
                             "score": pa.array([int(acc[i, k]) for i, at in tops for k in at], pa.int64())})
        for i, at in tops:  # a shard's own tenth is a bound, too
            if len(at) == TOP:
                bound[i] = max(bound[i], acc[i, at[-1]])
        acc[acc + rest[:, None] < bound[:, None]] = 0
        item, doc = np.nonzero(acc)
        return pa.table({
            "shard": pa.array([b["shard"]], pa.int64()), "part": pa.array([b["part"]], pa.int32()), "m": pa.array([b["m"]], pa.binary()),
            "ids": pa.array([b["ids"]], pa.list_(pa.int64())), "item": pa.array([item.astype(np.int32).tobytes()], pa.binary()),
            "doc": pa.array([doc.astype(np.int32).tobytes()], pa.binary()), "score": pa.array([acc[item, doc].tobytes()], pa.binary()),
            "tops": pa.array([[{"item": i, "score": int(acc[i, k])} for i, at in tops for k in at]], pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())])))})

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``TOP`` best documents: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    wanted = staged(item_terms(items, item_col, item_text), "item_terms")
    found = staged(index(docs, term_map(wanted), id_col, text_col), "index")
    shards = found.where("term is null")
    total = shards.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
    n, length = total["n"], max(1, total["l"])

    def m(x: str) -> str:
        return f"25L + (75L * {x} * {n}L) div {length}L"

    # each term's weight, owner, and the most that it can add once
    owner = F.lit(len(OWNERS))
    for k in reversed(range(len(OWNERS))):
        owner = F.when(F.col("df") <= OWNERS[k] * n, k).otherwise(owner)
    terms = found.where("term is not null").groupBy("term").agg(
        F.sum("count").alias("df"), F.max(F.expr(f"(1000000000L * most_tf) div (1000L * most_tf + 8L * ({m('least_n')}))")).alias("most"))
    terms = terms.select("term", "most", F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long").alias("w"), owner.alias("owner"))
    # items in parts, numbered within them
    count = wanted.select("item_id").distinct().count()
    parts = max(1, -(-count // PART_ITEMS))
    named = wanted.select("item_id").distinct().withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    named = staged(named.withColumn("item", (F.row_number().over(Window.partitionBy("part").orderBy("item_id")) - 1).cast("int")), "items")
    held = wanted.join(named, wanted["item_id"].eqNullSafe(named["item_id"])).select("part", "item", "term", "q").join(terms, "term")
    held = staged(held.withColumn("weight", F.col("q") * F.col("w")).withColumn("most", F.col("weight") * F.col("most")), "held")
    lists = held.where("weight > 0").groupBy("part", "term", "owner").agg(F.collect_list(F.struct("item", "weight")).alias("x")) \
        .select("part", "term", "owner", F.col("x.item").alias("items"), F.col("x.weight").alias("weights"))
    # rest: what the later owners can add to an item's score at most
    rest = named.join(held, ["part", "item"], "left").groupBy("part", "item").agg(
        *[F.coalesce(F.sum(F.when(F.col("owner") > k, F.col("most"))), F.lit(0)).alias(f"rest{k}") for k in range(len(OWNERS) + 1)])
    rest = staged(rest, "rest")

    none = F.lit(b"")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    bundles = shards.select("shard", F.col("numbers").alias("n"), "ids", numbers.alias("part")) \
        .select("shard", "part", "n", "ids", none.alias("item"), none.alias("doc"), none.alias("score"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(25 + 75 * np.frombuffer(x.as_buffer(), np.int64) * n // length).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(own, pa.binary()), *b.columns[3:]], names=["shard", "part", "m", "ids", "item", "doc", "score"])

    bundles = bundles.mapInArrow(lengths, "shard long, part int, m binary, ids array<long>, item binary, doc binary, score binary")
    bound = named.select("part", "item", F.lit(0).cast("long").alias("bound"))
    for k in range(len(OWNERS) + 1):
        last = k == len(OWNERS)
        limits = rest.select("part", "item", F.col(f"rest{k}").alias("rest")).join(bound, ["part", "item"], "left").groupBy("part") \
            .agg(F.sort_array(F.collect_list(F.struct("item", "rest", F.coalesce("bound", F.lit(0).cast("long")).alias("bound")))).alias("x")) \
            .select("part", F.col("x.rest").alias("rest"), F.col("x.bound").alias("bound"))
        left = bundles.drop("tops").join(limits, "part").groupBy("shard", "part")
        mine = lists.where(F.col("owner") == k).drop("owner")
        right = found.where("term is not null").select("shard", "term", "places", "numbers").join(mine, "term").groupBy("shard", "part")
        out = left.cogroup(right).applyInArrow(_stage(last), FOUND if last else BUNDLE)
        if last:
            order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
            return ranked.join(named, ["part", "item"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        bundles = staged(out, f"bundles{k}")
        tops = bundles.select("part", F.explode("tops").alias("t")).select("part", "t.item", "t.score")
        tenth = Window.partitionBy("part", "item").orderBy(F.desc("score"))
        bound = staged(tops.withColumn("r", F.row_number().over(tenth)).where(F.col("r") <= TOP).where(F.col("r") == TOP).select("part", "item", F.col("score").alias("bound")), "bound")
