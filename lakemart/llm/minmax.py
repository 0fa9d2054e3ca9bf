"""Near-duplicate documents by min-max hashing.

1. ``sign``: a document's set holds the 64-bit hashes of its distinct word n-grams.  Under each of ``PERMUTATIONS`` hash
   functions both the smallest and the largest value are kept, so half as many evaluations give a signature as long as
   MinHash would; a minimum and a maximum each agree with the probability of the sets' similarity, and errors of the two
   partly cancel.  ``ROWS`` values make a band: pairs at the threshold of 0.8 miss all bands once in about 10^7.
2. Equal sets become one vertex (grouped by digest, map-side first).
3. ``stars``: the sets of a bucket (band, values) pair with its smallest one; a pair of several buckets is one.  Both full
   sets confirm the pair.
4. ``rest``: only in buckets whose sets the confirmed pairs leave in several components can a link still be missing.  Buckets
   with the same sets are one.  Their full sets are compared inside tasks, in blocks of bounded bytes: what lies outside a
   bucket's largest component against all of the bucket.  No pairs of a group are written, none is capped.
5. Components of all confirmed links.

Defined results: a null text, or one without words, has an empty set (size 0), links with nothing and is kept; with fewer
than n words the whole sequence is one n-gram; rows of one id are one vertex (each row keeps its own size); a null id stays
null, has no links and no component, and is kept; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, blocks, mix, small_batches, staged, texts_of
from .components import components
from .sigtree import Sets, family_links, sets_of

#: Hash functions (each gives two values of the signature), and values of a band: an even number, so that a band takes both
#: values of its functions.
PERMUTATIONS, ROWS = 64, 4
#: Bytes of n-gram hashes of a block of a bucket.
BUCKET_BYTES = 4 << 20


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and masks of the hash functions ``(x ^ mask) * factor``."""
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mix(k * M1) | np.uint64(1), mix(k * M2)


def signature(s: Sets, n: int = PERMUTATIONS) -> np.ndarray:
    """The minima and maxima of each non-empty set under ``n`` functions: a row a set, minimum and maximum in turn."""
    some = s.first[s.size > 0]
    out = np.empty((2 * n, len(some)), np.uint64)
    held = np.empty_like(s.key)
    for k, (factor, mask) in enumerate(zip(*multipliers(n), strict=True)):
        np.bitwise_xor(s.key, mask, out=held)
        np.multiply(held, factor, out=held)
        np.minimum.reduceat(held, some, out=out[2 * k])
        np.maximum.reduceat(held, some, out=out[2 * k + 1])
    return out.T


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of ``ROWS`` values of each row."""
    n = values.shape[1] // ROWS
    key = np.arange(n, dtype=np.uint64) * M2
    for k in range(ROWS):
        key = mix(key * M1 + values[:, k::ROWS])
    return key


def sign(docs: DataFrame, n: int) -> DataFrame:
    """Each row's id, set size, the set's digest, and the keys of its bands (none for an empty set or a null id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, -1):
            s = Sets(texts_of(b.column(1)), n)
            d1, d2 = s.digest()
            count = np.where((s.size > 0) & ~np.asarray(b.column(0).is_null()), PERMUTATIONS * 2 // ROWS, 0)
            keys = np.zeros((s.docs, PERMUTATIONS * 2 // ROWS), np.int64)
            if len(s.key):
                keys[s.size > 0] = bands(signature(s)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.size.astype(np.int64)), pa.array(d1), pa.array(d2),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[count > 0].ravel()))], names=["id", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>")


def _confirm(num: int, den: int):
    """Of pairs with both sets, those that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (b.column(c) for c in (2, 3))
            link = np.zeros(b.num_rows, dtype=bool)
            for k in range(b.num_rows):
                s, t = np.frombuffer(one[k].as_buffer(), np.uint64), np.frombuffer(two[k].as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                if len(s) * den >= len(t) * num:
                    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                    link[k] = den * both >= num * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(link)) for c in (0, 1)], names=["a", "b"])

    return run


def _unit(num: int, den: int):
    """New links of a bucket's sets in one task: of side 0 with one another, or of side 3 with one another and side 2."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names, side, known = (table.column(c).to_numpy() for c in ("id", "side", "known"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        _, number = np.unique(known, return_inverse=True)
        found = np.array(family_links(names, sets, side, number, num, den) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def stars(buckets: DataFrame) -> DataFrame:
    """Distinct pairs of each bucket's smallest vertex with the others.  The smallest is an aggregate, joined back, so that a
    bucket with a third of all rows is summed up map-side and its join can be split."""
    least = buckets.groupBy("key").agg(F.min(F.struct("id", "d1", "d2")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = buckets.join(least.select("key", "l"), "key").where("id <> l.id or d1 <> l.d1 or d2 <> l.d2")
    return pairs.select(F.col("l.id").alias("a"), F.col("l.d1").alias("a1"), F.col("l.d2").alias("a2"), "id", "d1", "d2").distinct()


def rest(buckets: DataFrame, root: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside buckets between components that ``root`` leaves apart."""
    named = buckets.join(root, "id", "left").withColumn("known", F.coalesce("root", "id")).drop("root")
    # a bucket's sets as one number: buckets with the same sets are handled once
    parts = named.groupBy("key", "known").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("id", "d1", "d2")).alias("x"),
                                              F.bit_xor(F.xxhash64(F.lit(7), "id", "d1", "d2")).alias("y"))
    whole = parts.groupBy("key").agg(F.count(F.lit(1)).alias("several"), F.max(F.struct("n", "known")).alias("main"), F.sum("n").alias("all"),
                                     F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("several > 1")
    open_ = whole.groupBy("c", "x", "y").agg(F.min(F.struct("key", "main", "all")).alias("b")).select("b.key", "b.main", "b.all")
    size = F.greatest(F.lit(1), F.ceil(F.col("all") * 8 / BUCKET_BYTES)).cast("int")
    open_ = staged(open_.select("key", F.col("main.known").alias("main"), size.alias("nb"),
                                F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("main.n")) * 8 / BUCKET_BYTES)).cast("int").alias("rb")), "open")
    if open_.isEmpty():
        return root.select(F.col("id").alias("a"), F.col("root").alias("b")).limit(0)
    x = staged(named.join(open_, "key").select("key", "main", "nb", "rb", "id", "d1", "d2", "known"), "members").join(sets, ["id", "d1", "d2"])
    small = x.where("nb = 1").select("key", F.lit("").alias("part"), "id", F.lit(0).alias("side"), "known", "tokens")
    block, chunk = F.pmod(F.xxhash64("id", "d1"), F.col("nb")), F.pmod(F.xxhash64(F.lit(1), "id", "d1"), F.col("rb"))
    big = x.where("nb > 1")
    every = big.select("key", "id", "known", "tokens", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("chunk"))
    outside = big.where("known <> main").select("key", "id", "known", "tokens", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
    one = every.select("key", F.concat_ws("-", "chunk", "block").alias("part"), "id", F.lit(2).alias("side"), "known", "tokens")
    two = outside.select("key", F.concat_ws("-", "chunk", "block").alias("part"), "id", F.lit(3).alias("side"), "known", "tokens")
    return staged(small.unionByName(one).unionByName(two).groupBy("key", "part").applyInArrow(_unit(num, den), "a long, b long"), "rest")


def near_duplicates(docs: DataFrame, n: int = 4, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the size of its n-gram set, ``component_id`` (the smallest id that links reach from it) and ``kept``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = staged(sign(x, n), "signatures")
    full = seen.where("n > 0 and id is not null")
    # one vertex for equal sets: the keys come along, so that no row is joined back
    equal = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "keys")).alias("rep"), F.count(F.lit(1)).alias("c"))
    equal = staged(equal.select(F.col("rep.id").alias("rep"), "n", "d1", "d2", F.col("rep.keys").alias("keys"), "c"), "equal")
    several = equal.where("c > 1").select("rep", "n", "d1", "d2")
    copies = full.select("id", "n", "d1", "d2").join(several, ["n", "d1", "d2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    buckets = equal.select(F.col("rep").alias("id"), "n", "d1", "d2", F.explode("keys").alias("key"))
    pairs = staged(stars(buckets), "stars")
    ends = staged(pairs.select(F.col("a").alias("id"), F.col("a1").alias("d1"), F.col("a2").alias("d2")).unionByName(pairs.select("id", "d1", "d2")).distinct(), "ends")
    sets = staged(sets_of(x.where("id is not null"), ends.select("id").distinct(), n).join(ends, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"]), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("tokens").alias("one"))
    both = pairs.join(left, ["a", "a1", "a2"]).join(sets, ["id", "d1", "d2"]).select("a", F.col("id").alias("b"), "one", "tokens")
    near = staged(both.mapInArrow(_confirm(num, den), "a long, b long"), "near")
    edges = staged(near.unionByName(copies), "edges")
    far = rest(buckets, components(edges), sets, num, den)
    root = components(edges.unionByName(far))
    out = seen.join(root, "id", "left").select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
