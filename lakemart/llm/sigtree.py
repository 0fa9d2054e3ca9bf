"""Exact n-gram Jaccard self-join by signature trees.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Two documents link when
``den * |A & B| >= num * |A | B|``.

1. ``profile``: set sizes, and the n-grams that more than a few documents in a thousand hold.
2. ``routes``: documents that can link are brought together without loss.  Sizes are cut into
   bands so wide that linked documents lie in one band or two neighbouring ones.  Linked sets
   of a band differ in at most ``D`` n-grams, so of more than ``D`` parts (by hash) of the sets
   at least one is equal; there are so many more parts that linked sets share a number of keys,
   the band's ``need``.  A document sends a key for each part, for its own band and the next
   lower one.  Parts are built from n-grams that are not common; a document with too many
   empty parts sends keys over all its n-grams as well, cut in another way while too many are empty.  Documents that share ``need`` keys form
   families (``families``): one shared n-gram joins nothing, so that families do not grow
   together with the number of documents.
3. ``links``: in each family equal sets become one, and a signature tree holds the rest: its
   leaves are the sets' token bitmaps, a node ORs its children's bitmaps and spans their
   sizes.  A dual traversal drops pairs of nodes whose largest possible overlap is too small
   and pairs that are connected already, and compares the remaining sets exactly.  Large
   families are cut into blocks: each block against itself and against the family's first,
   then whatever is not in the family's largest component against all blocks.

Defined results: a null text, or one without words, has an empty set (size 0), links with
nothing and is its own component; with fewer than n words the whole sequence is one n-gram;
rows of one id are one vertex (each row keeps its own size); a null id stays null; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M1, M2, Words, blocks, mix, small_batches, staged, texts_of
from .components import components

TOKEN = np.ones(256, dtype=bool)
TOKEN[[9, 10, 11, 12, 13, 32]] = False

#: Sets of a block of a large family at most (and about UNIT_BYTES): each is sent once for every other block, so that few
#: large blocks move less.
BLOCK = 2048
#: Children of a tree node.
FAN = 8
#: Keys that linked sets share beyond the first: one of so many n-grams in which they can differ (rounded up).
SPARE = 8
#: Ways to cut all n-grams into parts, for documents that fill too few with those that are not common.
CUTS = 3
#: Documents of a key up to which all pairs of them are counted.
MANY = 64
#: Common n-grams: kept at most, and held by at least so many of a block's documents in 1000.
COMMON, COMMON_PER_MILLE = 1 << 16, 4


class Sets:
    """Sorted distinct n-gram hashes of each text of a block."""

    def __init__(self, texts: pa.Array, n: int):
        w = Words(texts, TOKEN)
        count = np.where(w.count >= n, w.count - n + 1, np.minimum(w.count, 1))
        doc = np.repeat(np.arange(len(count)), count)
        at = np.repeat(w.first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        # a short text's n-gram has all its words
        width = np.minimum(n, w.count)[doc]
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            live = width > k
            key[live] = mix(key[live] * M1 + w.key[at[live] + k] + np.uint64(k + 1))
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        self.key, self.doc = key[new], doc[new]
        self.docs = len(count)
        self.size = np.bincount(self.doc, minlength=self.docs)
        self.first = np.cumsum(self.size) - self.size

    def digest(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set."""
        out = []
        for m in (M1, M2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.key ^ m))])
            out.append((total[self.first + self.size] - total[self.first]).view(np.int64))
        return out[0], out[1]


class Bands:
    """Bands of set sizes, the most n-grams in which linked sets of a band (and the next) can
    differ, the keys that linked sets share at least, and the parts that sets are cut into."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.differ, self.need, self.parts = [1], [], [], []
        self._grow(1 << 10)

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            upper = self.low[-1] * self.den // self.num
            larger = upper * self.den // self.num
            d = (upper + larger) * (self.den - self.num) // (self.den + self.num)
            need = 1 + -(-d // SPARE)
            self.differ.append(d)
            self.need.append(need)
            self.parts.append(self._parts(self.low[-1], d + need) if d else 1)
            self.low.append(upper + 1)

    @staticmethod
    def _parts(size: int, least: int) -> int:
        """Parts of which nearly all sets of a size (all within three deviations) fill ``least``."""
        n = least
        while n < max(size, least + 2):
            c = size / n
            empty = n * math.exp(-c)
            if n - empty - 3 * math.sqrt(empty * max(0.0, 1 - (1 + c) * math.exp(-c))) >= least:
                break
            n += max(1, n // 64)
        return n

    def of(self, size: np.ndarray) -> np.ndarray:
        if len(size):
            self._grow(int(size.max()) + 1)
        return np.searchsorted(np.array(self.low), size, side="right") - 1


def part_keys(s: Sets, docs: np.ndarray, band: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of documents ``docs`` in the bands named, and the document of each.  A key's last byte
    is the number of keys that linked sets share (255: so many or more).  A document that fills too
    few parts for that sends keys by the next way of cutting, too: over all n-grams, ``CUTS`` times."""
    need, parts = np.array(bands.need)[band], np.array(bands.parts)[band]
    least = np.array(bands.differ)[band] + need
    code = np.minimum(need, 255).astype(np.uint64)
    out_key, out_doc = [], []
    wanted = np.arange(len(docs))
    for kind in range(CUTS + 1):
        mine, n = docs[wanted], parts[wanted]
        size = s.size[mine]
        own = np.repeat(np.arange(len(mine)), size)
        key = s.key[np.repeat(s.first[mine] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        if not kind and len(common):
            rare = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] != key
            own, key = own[rare], key[rare]
        where = np.cumsum(n) - n  # first part of each document
        slot = where[own] + ((mix(key ^ (M2 + np.uint64(kind))) >> np.uint64(24)) % n[own].astype(np.uint64)).astype(np.int64)
        owner = np.repeat(np.arange(len(mine)), n)
        part = np.arange(len(owner)) - where[owner]
        total = np.zeros(len(owner), np.uint64)
        order = np.argsort(slot, kind="stable")
        held, start = np.unique(slot[order], return_index=True)
        if len(held):
            total[held] = np.add.reduceat(mix(key[order] + M1), start)
        full = np.zeros(len(owner), dtype=bool)
        full[held] = True
        unsafe = np.bincount(owner[full], minlength=len(mine)) < least[wanted]  # too many of the equal parts could be empty ones
        send = full | unsafe[owner] if kind == CUTS else full
        name = mix(total + mix((band[wanted][owner] * (CUTS + 1) + kind).astype(np.uint64) * M1 + part.astype(np.uint64) * M2))
        out_key.append((name[send] & ~np.uint64(255)) | code[wanted][owner[send]])
        out_doc.append(mine[owner[send]])
        wanted = wanted[unsafe]
        if not len(wanted):
            break
    return np.concatenate(out_key), np.concatenate(out_doc)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def profile(docs: DataFrame, n: int) -> DataFrame:
    """(kind 0) each row's id, set size and the set's digest; (kind 1) n-grams common in a block,
    and in how many of its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, -1):
            s = Sets(texts_of(b.column(1)), n)
            key, count = np.unique(s.key, return_counts=True)
            often = np.flatnonzero(count >= max(4, b.num_rows * COMMON_PER_MILLE // 1000))
            none = pa.nulls(len(often), pa.int64())
            d1, d2 = s.digest()
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(np.zeros(s.docs, np.int8)), pa.array(np.ones(len(often), np.int8))]),
                pa.concat_arrays([b.column(0), pa.array(key[often].view(np.int64))]),
                pa.concat_arrays([pa.array(s.size.astype(np.int64)), pa.array(count[often].astype(np.int64))]),
                pa.concat_arrays([pa.array(d1), none]), pa.concat_arrays([pa.array(d2), none])], names=["kind", "a", "b", "d1", "d2"])

    return docs.mapInArrow(run, "kind byte, a long, b long, d1 long, d2 long")


def tied(key: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each document of a block the one that stands for it: of documents that share enough
    keys with the first document of each key, the one with the least id (rows sorted by key and id)."""
    lead = np.arange(len(ids))
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    head = doc[first][np.cumsum(first) - 1]
    need = (key & np.uint64(255)).astype(np.int64)
    star, count = np.unique(np.stack([head, doc, need], axis=1)[~first], axis=0, return_counts=True)

    def top(x: int) -> int:
        while lead[x] != x:
            lead[x] = x = lead[lead[x]]
        return x

    for a, b in star[count >= star[:, 2], :2].tolist():
        x, y = sorted((top(a), top(b)), key=lambda d: ids[d])
        lead[y] = x
    while (lead[lead] != lead).any():
        lead = lead[lead]
    return lead


def routes(docs: DataFrame, n: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """The documents' keys: ``key, id``.  In a block one document stands for all that share enough
    keys with it; a key of their own (last byte 0) ties each of them to it."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in blocks(batches, -1):
            s = Sets(texts_of(b.column(1)), n)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            some = np.flatnonzero(s.size > 0)
            if not len(some):
                continue
            # equal sets of the block send their keys once, under their smallest id
            d1, d2 = s.digest()
            order = some[np.lexsort((ids[some], d2[some], d1[some]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (d1[order[1:]] != d1[order[:-1]]) | (d2[order[1:]] != d2[order[:-1]])
            single = order[new]
            band = bands.of(s.size[single])
            guest = band > 0
            key, doc = part_keys(s, np.concatenate([single, single[guest]]), np.concatenate([band, band[guest] - 1]), bands, sent.value)
            order2 = np.lexsort((ids[doc], key))
            key, doc = key[order2], doc[order2]
            lead = tied(key, doc, ids)
            # a key's documents that one stands for: one row
            doc = lead[doc]
            several = np.zeros(len(key), dtype=bool)
            several[1:] = key[1:] == key[:-1]
            several[:-1] |= several[1:]
            rows = np.unique(np.stack([key[several].view(np.int64), doc[several]], axis=1), axis=0)
            key = np.concatenate([key[~several], rows[:, 0].view(np.uint64)])
            doc = np.concatenate([doc[~several], rows[:, 1]])
            tie_a, tie_b = ids[lead[single[np.cumsum(new) - 1]]], ids[order]
            tie_a, tie_b = tie_a[tie_a != tie_b], tie_b[tie_a != tie_b]
            knot = mix(tie_a.astype(np.uint64) * M1 + mix(tie_b.astype(np.uint64))) & ~np.uint64(255)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, knot, knot]).view(np.int64)),
                                              pa.array(np.concatenate([ids[doc], tie_a, tie_b]))], names=["key", "id"])

    return docs.where("id is not null").mapInArrow(run, "key long, id long")


def families(keys: DataFrame) -> DataFrame:
    """``(id, root)`` of documents that can link with another one: linked documents have one root.

    First the documents that share enough keys with the least one of each key are joined: near
    copies meet here, however many they are.  Then all pairs that a key still holds apart are
    counted, and those with enough keys are joined.  Of a key with more than ``MANY`` apart the
    pairs are not counted: such a key lowers what its documents need, and joins only those of them
    that can do without others."""
    need = F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int").alias("need")
    ends = [F.expr(f"{f}(id) over (partition by key)").alias(f"{f}_id") for f in ("min", "max")]
    shared = staged(keys.select("key", "id", *ends).where("min_id <> max_id").select("key", "id", F.col("min_id").alias("a")), "shared")
    stars = shared.where("id <> a").groupBy("a", F.col("id").alias("b"), need).agg(F.count(F.lit(1)).alias("n"))
    first = components(stars.where("n >= need"))
    apart = shared.join(first, "id", "left").select("key", F.coalesce("root", "id").alias("id")).repartition("key").distinct()
    apart = staged(apart.withColumn("n", F.expr("count(1) over (partition by key)")).where("n > 1").select("key", "id", "n", need), "apart")
    loose = F.count(F.when(F.col("n") > MANY, 1)).over(Window.partitionBy("id", "need"))
    apart = staged(apart.withColumn("loose", loose), "loose")
    few, many = apart.where(F.col("n") <= MANY), apart.where(F.col("n") > MANY).where("loose >= need")
    other = few.select("key", F.col("id").alias("b"), F.col("loose").alias("loose_b"))
    pairs = few.withColumnRenamed("id", "a").join(other, "key").where("a < b").groupBy("a", "b", "need") \
        .agg((F.count(F.lit(1)) + F.max(F.least("loose", "loose_b"))).alias("n")).where("n >= need")
    many = many.select(F.expr("min(id) over (partition by key)").alias("a"), F.col("id").alias("b"))
    return components(first.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(pairs.select("a", "b")).unionByName(many))


class Tree:
    """A signature tree over sorted token sets: level 0 are the sets, each node of a higher
    level has up to FAN children."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        size = np.array([len(s) for s in sets])
        words = bits // 64
        bitmap = np.zeros((len(sets), words), np.uint64)
        own = np.repeat(np.arange(len(sets)), size)
        bit = (np.concatenate(sets) >> np.uint64(8)) & np.uint64(bits - 1)
        np.bitwise_or.at(bitmap, (own, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        # n-grams beyond the set's number of bits: as many can fall on any bits
        slack = size - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
        # similar sets next to each other: by size, then by smallest hash
        self.order = np.lexsort((np.array([s[0] for s in sets]), size))
        self.levels = [(bitmap[self.order], size[self.order], size[self.order], slack[self.order])]
        while len(self.levels[-1][1]) > 1:
            b, low, high, sl = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(sl, at)))


class Joined:
    """Sets already connected to one another: an array of component names."""

    def __init__(self, names: np.ndarray):
        self.name = names.copy()
        self.members = {}
        for k, x in enumerate(self.name.tolist()):
            self.members.setdefault(x, []).append(k)

    def join(self, a: int, b: int) -> None:
        x, y = self.name[a], self.name[b]
        if x == y:
            return
        x, y = int(x), int(y)
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        moved = self.members.pop(y)
        self.name[moved] = x
        self.members[x] += moved


#: Node pairs that are bounded at once.
PAIRS = 1 << 13


def dual(a: Tree, b: Tree, base_a: np.ndarray, base_b: np.ndarray, num: int, den: int, known: Joined) -> list[tuple[int, int]]:
    """Links between sets of two trees (or of one with itself) that connect what was not
    connected: positions, as ``base_a`` and ``base_b`` number the trees' sets in ``known``."""
    same = a is b
    found: list[tuple[int, int]] = []
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros((1, 2), np.int64))]
    while stack:
        level, pairs = stack.pop()
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        (ba, lo_a, hi_a, sl_a), (bb, lo_b, hi_b, sl_b) = a.levels[la], b.levels[lb]
        i, j = pairs[:, 0], pairs[:, 1]
        fits = (hi_a[i] * den >= lo_b[j] * num) & (hi_b[j] * den >= lo_a[i] * num)
        i, j = i[fits], j[fits]
        most = np.bitwise_count(ba[i] & bb[j]).sum(axis=1).astype(np.int64) + np.minimum(sl_a[i], sl_b[j])
        most = np.minimum(most, np.minimum(hi_a[i], hi_b[j]))
        fits = most * (num + den) >= (lo_a[i] + lo_b[j]) * num
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if level == 0:
            x, y = a.order[i], b.order[j]
            p, q = base_a[x], base_b[y]
            if same:
                x, y, p, q = x[i < j], y[i < j], p[i < j], q[i < j]
            for k in np.flatnonzero(known.name[p] != known.name[q]):
                if known.name[p[k]] == known.name[q[k]]:
                    continue
                s, t = a.sets[x[k]], b.sets[y[k]]
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                if den * both >= num * (len(s) + len(t) - both):
                    known.join(int(p[k]), int(q[k]))
                    found.append((int(p[k]), int(q[k])))
            continue
        below_a, below_b = min(level - 1, len(a.levels) - 1), min(level - 1, len(b.levels) - 1)
        ca = _children(i, la, below_a, len(a.levels[below_a][1]))
        cb = _children(j, lb, below_b, len(b.levels[below_b][1]))
        left = np.repeat(ca, cb.shape[1], axis=1).ravel()
        right = np.tile(cb, (1, ca.shape[1])).ravel()
        keep = (left >= 0) & (right >= 0)
        if same:
            keep &= left <= right
        nxt = np.stack([left[keep], right[keep]], axis=1)
        for k in range(0, len(nxt), PAIRS):
            stack.append((level - 1, nxt[k:k + PAIRS]))
    return found


def _children(nodes: np.ndarray, level: int, below: int, size: int) -> np.ndarray:
    """Children of each node, -1 where there are fewer; a tree that is at its leaves stays."""
    if level == below:
        return nodes[:, None]
    out = nodes[:, None] * FAN + np.arange(FAN)
    out[out >= size] = -1
    return out


def family_links(names: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """New links of one family's sets.  ``side`` 0: compared with one another and with side 1;
    1: with side 0 only; 2: with side 3; 3: with side 2 and one another."""
    bits = 64
    while bits < 2 * max(map(len, sets)) and bits < 1 << 16:
        bits *= 2
    joined = Joined(known)
    tree = {}
    at = {}
    for k in range(4):
        own = np.flatnonzero(side == k)
        if len(own):
            at[k], tree[k] = own, Tree([sets[x] for x in own], bits)
    found = []
    for x, y in ((0, 0), (3, 3), (0, 1), (3, 2)):
        if x in tree and y in tree:
            found += dual(tree[x], tree[y], at[x], at[y], num, den, joined)
    return [(int(names[x]), int(names[y])) for x, y in found]


def _unit(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        family = table.column("family").to_numpy()
        order = np.argsort(family, kind="stable")
        names, side, known = (table.column(c).to_numpy() for c in ("id", "side", "known"))
        tokens = table.column("tokens")
        out: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.diff(family[order])) + 1
        for own in np.split(order, cuts):
            if len(own) < 2:
                continue
            sets = [np.frombuffer(tokens[int(k)].as_buffer(), np.uint64) for k in own]
            _, number = np.unique(known[own], return_inverse=True)
            out += family_links(names[own], sets, side[own], number, num, den)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


#: Bytes of n-gram hashes that small families are put together to, and that large ones are cut into.
UNIT_BYTES = 8 << 20


#: Bits of the map of ids that selects which texts are read for their sets.
MOST_BITS = 1 << 26


def id_map(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A map of hashed ids: how many bits (16 for each id, at most ``MOST_BITS``: 8 MB, whatever
    the number of ids), and the bits.  An id that is not among ``ids`` may be set too; the
    join that follows drops it."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (16 * ids.count()).bit_length()))
    part = 1 << 12

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(part, dtype=bool)
        own[table.column("p").to_numpy() % part] = True
        return pa.table({"k": table.column("k").slice(0, 1), "m": pa.array([np.packbits(own).tobytes()], pa.binary())})

    places = ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p")).distinct().withColumn("k", (F.col("p") / part).cast("int"))
    out = np.zeros((bits // part, part // 8), np.uint8)
    for r in places.groupBy("k").applyInArrow(pack, "k int, m binary").collect():
        out[r["k"]] = np.frombuffer(r["m"], np.uint8)
    return bits, out.ravel()


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The sets of at least the documents in ``ids``: id, digest and sorted n-gram hashes."""
    bits, held = id_map(ids)
    sent = docs.sparkSession.sparkContext.broadcast(held)  # at most MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen():
            for b in batches:
                p = b.column(1).to_numpy()
                yield b.filter(pa.array((sent.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)))

        for b in blocks(chosen(), -1):
            s = Sets(texts_of(b.column(2)), n)
            d1, d2 = s.digest()
            raw = [s.key[f:f + k].tobytes() for f, k in zip(s.first, s.size, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d1), pa.array(d2), pa.array(raw, pa.binary())], names=["id", "d1", "d2", "tokens"])

    return docs.select("id", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p"), "text").mapInArrow(run, "id long, d1 long, d2 long, tokens binary")


def _blocks(sets, tokens):
    """Blocks that so many sets, with so many n-grams in all, are cut into."""
    return F.greatest(F.lit(1), F.ceil(sets / F.lit(BLOCK)), F.ceil(tokens * 8 / F.lit(UNIT_BYTES))).cast("int")


def links(docs: DataFrame, seen: DataFrame, family: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect exactly the linked documents of each family; ``seen``: the
    documents' ids, set sizes and digests."""
    mine = staged(seen.where("n > 0").join(family.select("id", F.col("root").alias("family")), "id"), "mine")
    # one set for equal ones: grouped by digest, a large group of copies is summed up in the map tasks
    equal = mine.groupBy("family", "n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    equal = staged(equal, "equal")
    copies = mine.join(equal.where("rows > 1"), ["family", "n", "d1", "d2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    count = equal.groupBy("family").agg(F.count(F.lit(1)).alias("g"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("nb"))
    several = staged(count.where("g > 1"), "several")
    chosen = staged(equal.join(several, "family").select("family", "g", "nb", F.col("rep").alias("id"), "d1", "d2"), "chosen")
    # the same join at every size: the sets are dealt out by id
    reps = staged(sets_of(docs, chosen.select("id"), n).join(chosen.hint("merge"), ["id", "d1", "d2"]).select("family", "g", "nb", "id", "tokens"), "reps")
    size = reps.agg(F.sum(F.length("tokens")).alias("s")).first()["s"] or 0
    units = max(1, -(-size // UNIT_BYTES))
    own_block = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    x = reps.withColumn("block", own_block).withColumn("known", F.col("id"))
    schema = "a long, b long"
    # first: small families whole; blocks of large ones with themselves and with the family's first block
    small = x.where("nb = 1").select(F.pmod(F.xxhash64("family"), F.lit(units)).alias("unit"), F.lit(0).alias("part"), "family", "id", F.lit(0).alias("side"), "known", "tokens")
    big = x.where("nb > 1")
    inner = big.select(F.col("family").alias("unit"), F.col("block").alias("part"), "family", "id", F.lit(0).alias("side"), "known", "tokens")
    first = big.where("block = 0").select("family", "nb", "id", "known", "tokens", F.explode(F.sequence(F.lit(1), F.col("nb") - 1)).alias("part")) \
        .select(F.col("family").alias("unit"), "part", "family", "id", F.lit(1).alias("side"), "known", "tokens")
    near = staged(small.unionByName(inner).unionByName(first).groupBy("unit", "part").applyInArrow(_unit(num, den), schema), "near")
    edges = near.unionByName(copies)
    if several.where("nb > 1").isEmpty():
        return edges
    # then: what lies outside a large family's largest component, against all its blocks
    root = components(near)
    y = staged(big.drop("known").join(root, "id", "left").withColumn("known", F.coalesce("root", "id")).drop("root"), "grouped")
    main = y.groupBy("family", "known").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("tokens") / 8).alias("kt")) \
        .groupBy("family").agg(F.max(F.struct("k", "known", "kt")).alias("m"), F.sum("kt").alias("t")) \
        .select("family", F.col("m.known").alias("main"), F.col("m.k").alias("k"), (F.col("t") - F.col("m.kt")).alias("t"))
    y = y.join(main, "family").where("k < g")
    rest = y.where("known <> main").withColumn("rb", _blocks(F.col("g") - F.col("k"), F.col("t"))) \
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.col("rb")).cast("int"))
    chunks = rest.select("family", "chunk", "rb").distinct()
    right = y.join(chunks, "family").select("family", F.concat_ws("-", "chunk", "block").alias("part"), "id", F.lit(2).alias("side"), "known", "tokens")
    left = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("to")) \
        .select("family", F.concat_ws("-", "chunk", "to").alias("part"), "id", F.lit(3).alias("side"), "known", "tokens")
    far = staged(left.unionByName(right).groupBy("family", "part").applyInArrow(_unit(num, den), schema), "far")
    return edges.unionByName(far)


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, the size of its n-gram set and ``component_id``, the smallest id
    that links reach from it (a document without links: its own)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    x = _texts(docs, id_col, text_col)
    seen = staged(profile(x, n), "profile")
    often = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).orderBy(F.desc("b"), "a").limit(COMMON).collect()
    common = np.sort(np.array([r["a"] for r in often], np.int64).view(np.uint64))
    family = families(routes(x, n, num, den, common))
    sizes = seen.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), "d1", "d2")
    root = components(links(x.where("id is not null"), sizes, family, n, num, den))
    return sizes.join(root, "id", "left").select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").cast(kind).alias("component_id"))
