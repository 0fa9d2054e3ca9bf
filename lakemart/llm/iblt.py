"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text is read as paragraphs: its lines, and inside a line the stretches between
content-defined cuts (after words whose hash is 0 modulo ``CUT``), so that an edit changes the
paragraphs around it and no others.  A paragraph's digest holds 48 bits of hash (of its bytes
and of its number among equal paragraphs) and 16 bits of length.  A sketch is a small table of
cells (count, XOR of digests, XOR of checks); every digest is in three cells.  Subtracting the
sketches of two versions cell by cell leaves the paragraphs that differ; cells with a single
digest give it away and are peeled until the table is empty.  A table that cannot be peeled
was too small for the difference, and the comparison is made again with one of ``GROW`` times
the cells.  ``likeness`` is the common length of the recovered difference against the whole:
(a + b - d) / (a + b + d), 1 for equal texts and for two empty ones.

All steps run over a block of documents at once (numpy); a task's memory is bounded by the
block.  Defined results: a null text is an empty one and its sketch is all zeros; equal texts
have equal fingerprints; rows of equal id follow one another by text, null ids come last; a
lone document is its own successor; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, BLOCK_BYTES, hash_spans, mix, segment_sum, small_batches, text_bytes

#: Cells of a fingerprint; of these each third is addressed by a hash function of its own.
CELLS = 18
#: A failed comparison is made again with so many times the cells.
GROW = 3
#: Words after which a line is cut: one in so many.
CUT = 8

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LENGTH = np.uint64(0xFFFF)


class Paragraphs:
    """Digests of the paragraphs of a block of texts, by document."""

    def __init__(self, texts: list[str]):
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        n = len(data)
        space = SPACES[data]
        begin = np.ones(n, dtype=bool)  # a word and the white space behind it
        begin[1:] = space[:-1] & ~space[1:]
        begin[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
        key = hash_spans(data, start, end)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        last = (lines[end] > lines[start]) | (key % np.uint64(CUT) == 0)
        doc = np.searchsorted(offsets, start, side="right") - 1
        last[:-1] |= doc[1:] != doc[:-1]
        if len(last):
            last[-1] = True
        tail = np.flatnonzero(last)
        head = np.append(0, tail[:-1] + 1)[:len(tail)]
        within = (np.arange(len(key)) - np.repeat(head, tail - head + 1)).astype(np.uint64)
        words = mix(key + mix(within * M1 + M2))
        digest = mix(np.add.reduceat(words, head)) if len(head) else np.zeros(0, np.uint64)
        length = np.minimum(end[tail] - start[head], 0xFFFF).astype(np.uint64)
        doc = doc[head]
        order = np.lexsort((digest, doc))
        digest, doc, length = digest[order], doc[order], length[order]
        fresh = np.ones(len(digest), dtype=bool)
        fresh[1:] = (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        turn = np.arange(len(digest)) - np.repeat(first, np.diff(np.append(first, len(digest))))
        self.doc = doc
        self.digest = (mix(digest + turn.astype(np.uint64) * M1) & ~LENGTH) | length
        self.docs = len(texts)
        self.first = np.searchsorted(doc, np.arange(self.docs))
        self.count = np.searchsorted(doc, np.arange(self.docs), side="right") - self.first
        self.weight = segment_sum(length.astype(np.int64), self.first, self.count)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the documents asked for, and which of those each belongs to."""
        count = self.count[docs]
        at = np.repeat(self.first[docs] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self.digest[at], np.repeat(np.arange(len(docs)), count)


def check(digest: np.ndarray) -> np.ndarray:
    return mix(digest ^ M1).astype(np.uint32)


class Sketches:
    """One table of ``cells`` cells for each of ``tables`` documents."""

    def __init__(self, tables: int, cells: int, salt: int = 0):
        self.tables, self.cells, self.salt = tables, cells, salt
        self.n = np.zeros(tables * cells, np.int32)
        self.x = np.zeros(tables * cells, np.uint64)
        self.c = np.zeros(tables * cells, np.uint32)

    def places(self, digest: np.ndarray, table: np.ndarray) -> Iterator[np.ndarray]:
        third = self.cells // 3
        for k in range(3):
            seed = np.uint64((k + 1 + 3 * self.salt) * int(M2) & 0xFFFFFFFFFFFFFFFF)
            h = mix(digest + seed) >> np.uint64(32)
            yield table * self.cells + k * third + (h % np.uint64(third)).astype(np.int64)

    def put(self, digest: np.ndarray, table: np.ndarray, sign) -> Sketches:
        own = check(digest)
        for at in self.places(digest, table):
            np.add.at(self.n, at, sign)
            np.bitwise_xor.at(self.x, at, digest)
            np.bitwise_xor.at(self.c, at, own)
        return self

    def minus(self, other: Sketches, mine: np.ndarray, theirs: np.ndarray) -> Sketches:
        """Table ``mine[i]`` less the other's table ``theirs[i]``, for each i."""
        out = Sketches(len(mine), self.cells, self.salt)
        shape = (-1, self.cells)
        out.n = (self.n.reshape(shape)[mine] - other.n.reshape(shape)[theirs]).ravel()
        out.x = (self.x.reshape(shape)[mine] ^ other.x.reshape(shape)[theirs]).ravel()
        out.c = (self.c.reshape(shape)[mine] ^ other.c.reshape(shape)[theirs]).ravel()
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered digests, their tables and signs, and which tables came out empty."""
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(self.n | (self.c != 0))
        for _ in range(4 * self.cells + 16):  # a wrong check could go round for ever
            single = look[(np.abs(self.n[look]) == 1)]
            single = single[check(self.x[single]) == self.c[single]]
            if not len(single):
                break
            digest, table, sign = self.x[single], single // self.cells, self.n[single]
            order = np.lexsort((digest, table))
            digest, table, sign = digest[order], table[order], sign[order]
            new = np.ones(len(digest), dtype=bool)
            new[1:] = (digest[1:] != digest[:-1]) | (table[1:] != table[:-1])
            digest, table, sign = digest[new], table[new], sign[new]
            got.append((digest, table, sign))
            self.put(digest, table, -sign)
            look = np.unique(np.concatenate(list(self.places(digest, table))))
        empty = ~((self.n != 0) | (self.x != 0) | (self.c != 0)).reshape(self.tables, self.cells).any(axis=1)
        if not got:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), empty
        return *(np.concatenate(x) for x in zip(*got, strict=True)), empty

    def text(self) -> list[str]:
        """Each table as text: counts, digests and checks, little-endian, base 64."""
        rows = np.concatenate([
            self.n.astype("<i4").reshape(self.tables, -1).view(np.uint8), self.x.astype("<u8").reshape(self.tables, -1).view(np.uint8),
            self.c.astype("<u4").reshape(self.tables, -1).view(np.uint8)], axis=1)
        return [base64.b64encode(r.tobytes()).decode() for r in rows]


def from_text(fingerprints: list[str]) -> Sketches:
    """Fingerprint strings back to tables (all of one size)."""
    raw = np.array([np.frombuffer(base64.b64decode(f), np.uint8) for f in fingerprints])
    cells = raw.shape[1] // 16
    out = Sketches(len(raw), cells)
    out.n = np.ascontiguousarray(raw[:, :4 * cells]).view("<i4").ravel().astype(np.int32)
    out.x = np.ascontiguousarray(raw[:, 4 * cells:12 * cells]).view("<u8").ravel().astype(np.uint64)
    out.c = np.ascontiguousarray(raw[:, 12 * cells:]).view("<u4").ravel().astype(np.uint32)
    return out


def sketch(p: Paragraphs, cells: int = CELLS) -> Sketches:
    return Sketches(p.docs, cells).put(p.digest, p.doc, 1)


def differences(a: Paragraphs, sa: Sketches, b: Paragraphs, sb: Sketches, ia: np.ndarray, ib: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests that only one of document ``ia[i]`` of ``a`` and ``ib[i]`` of ``b`` has, the
    pair each belongs to, and +1 (in a) or -1 (in b): first from the fingerprints alone, for
    the pairs that fail from ever larger sketches."""
    digest, pair, sign, done = sa.minus(sb, ia, ib).peel()
    ok = done[pair]
    found = [(digest[ok], pair[ok], sign[ok])]
    left, cells, salt = np.flatnonzero(~done), sa.cells, 0
    while len(left):
        cells, salt = cells * GROW, salt + 1
        da, ta = a.of(ia[left])
        db, tb = b.of(ib[left])
        if salt > 20:  # cannot be a matter of size any more: compare the digests themselves
            digest, pair, sign = apart(da, ta, db, tb)
            done = np.ones(len(left), dtype=bool)
        else:
            digest, pair, sign, done = _in_parts(left, cells, salt, da, ta, db, tb)
        ok = done[pair]
        found.append((digest[ok], left[pair[ok]], sign[ok]))
        left = left[~done]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Cells that are worked on at once.
AT_ONCE = 1 << 21


def _in_parts(left, cells, salt, da, ta, db, tb):
    """Peel tables of ``cells`` cells for all pairs left, so many at a time that memory holds."""
    step = max(1, AT_ONCE // cells)
    out, done = [], []
    for k in range(0, len(left), step):
        a0, a1 = np.searchsorted(ta, [k, k + step])
        b0, b1 = np.searchsorted(tb, [k, k + step])
        s = Sketches(min(step, len(left) - k), cells, salt).put(da[a0:a1], ta[a0:a1] - k, 1).put(db[b0:b1], tb[b0:b1] - k, -1)
        digest, pair, sign, ok = s.peel()
        out.append((digest, pair + k, sign))
        done.append(ok)
    return *(np.concatenate(x) for x in zip(*out, strict=True)), np.concatenate(done)


def apart(da, ta, db, tb):
    """The symmetric difference of two lists of (table, digest)."""
    table, digest = np.concatenate([ta, tb]), np.concatenate([da, db])
    sign = np.concatenate([np.ones(len(da), np.int32), -np.ones(len(db), np.int32)])
    order = np.lexsort((digest, table))
    table, digest, sign = table[order], digest[order], sign[order]
    same = (table[1:] == table[:-1]) & (digest[1:] == digest[:-1])
    both = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return digest[~both], table[~both], sign[~both]


def likeness(a: Paragraphs, sa: Sketches, b: Paragraphs, sb: Sketches, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    digest, pair, _ = differences(a, sa, b, sb, ia, ib)
    d = np.bincount(pair, weights=(digest & LENGTH).astype(np.float64), minlength=len(ia))
    whole = (a.weight[ia] + b.weight[ib]).astype(np.float64)
    return np.where(whole + d > 0, (whole - d) / np.maximum(whole + d, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last third of a text (in code points) replaced by the beginning of the next."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


SCHEMA = ("id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows dealt to partitions by ranges of the (numeric) id and sorted by descending id
    in each; every partition ends with copies (``ghost``) of the row that follows its last
    one, the whole table's first row after its last.  One shuffle; only the ranges' bounds and
    greatest ids, a few for each partition, reach the driver."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = x.select(F.col("id").cast("double").alias("key"), "id")
    bounds = sorted(set(ids.approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    # null ids come after all others: range 0; the others from 1 on
    if bounds:
        cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="key", outputCol="range", handleInvalid="keep").transform
        place = F.when(F.col("id").isNull(), 0).otherwise(F.col("range").cast("int") + 1)
    else:  # one value at most
        cut, place = lambda df: df, F.when(F.col("id").isNull(), 0).otherwise(1)
    heads = {r["range"]: r["top"] for r in cut(ids).select(place.alias("range"), "id").groupBy("range").agg(F.max("id").alias("top")).collect()}
    ranges = sorted(heads)
    # a range's first row follows the last row of the next higher range: a row a range, joined by the id
    kind = docs.schema[id_col].dataType.simpleString()
    follows = [(heads[r], ranges[(k + 1) % len(ranges)]) for k, r in enumerate(ranges)]
    firsts = F.broadcast(spark.createDataFrame(follows, f"top {kind}, above int"))  # as many rows as ranges
    placed = cut(x.withColumn("key", F.col("id").cast("double"))).withColumn("range", place).select("id", "text", "range")
    placed = placed.join(firsts, F.col("id").eqNullSafe(F.col("top")), "left")
    dealt = placed.select("id", "text", F.explode(F.array(F.struct("range", F.lit(0).alias("ghost")), F.struct(F.col("above").alias("range"), F.lit(1).alias("ghost")))).alias("p")) \
        .select("id", "text", F.col("p.range").alias("range"), F.col("p.ghost").alias("ghost")).where("range is not null")
    return dealt.repartitionById(len(bounds) + 3, F.col("range")) \
        .sortWithinPartitions("range", "ghost", F.col("id").desc_nulls_last(), "text").select("id", "text", "ghost")


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Fingerprints and likenesses of all rows but the last, which only follows."""
    n = len(ids) - 1
    changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    a, b = Paragraphs(texts), Paragraphs(changed)
    sa, sb = sketch(a), sketch(b)
    at = np.arange(n)
    fingerprint = sa.text()
    return pa.RecordBatch.from_pydict({
        "id": pa.array(ids[:n], pa.string()), "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(fingerprint[:n], pa.string()), "edited_fingerprint": pa.array(sb.text(), pa.string()),
        "near_edited": pa.array(likeness(a, sa, b, sb, at, at), pa.float64()),
        "near_next": pa.array(likeness(a, sa, a, sa, at, at + 1), pa.float64())})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited version (``edited`` with the next document
    by descending id), and its likeness to both."""
    kind = docs.schema[id_col].dataType
    rows = successors(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, over = 0, False
        for batch in batches:
            for i, t, ghost in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if over:  # more rows tie with the one that follows
                    break
                ids.append(i)
                texts.append(t)
                size += len(t)
                over = bool(ghost)
                if size >= BLOCK_BYTES // 2 and len(ids) > 1 or over:
                    yield _rows(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)

    small_batches(docs.sparkSession, 1000)
    return rows.select(F.col("id").cast("string").alias("id"), "text", "ghost").mapInArrow(run, SCHEMA) \
        .withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
