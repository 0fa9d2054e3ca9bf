"""Alignment of two tokenizers' tokens over the same bytes.

Text A is encoded by a byte-level BPE file (JSON), text B by a sentencepiece model; both cover the bytes of a space and the
text.  ``blocks_of`` works batch by batch: the tokens' byte starts of all documents of a batch lie end to end, and
``pandas.merge_asof``, keyed by document, finds for each token start the other side's token that covers it, in both
directions; the union of the two is all overlapping pairs (a pair whose tokens start together is found twice and kept
once).  Byte offsets where an A and a B token both end cut the tokens into groups.

How often two ids overlap in the whole corpus is counted in Spark: batches are put together to blocks of about
``BLOCK_BYTES`` of text; a row of the written table holds a block's documents and its distinct id pairs with their numbers;
pairs are summed up over blocks (map-side first), each B id's highest count follows, and the blocks' pairs, joined with the
counts, go back to their block, where each document's sums are made.  No table of all pairs is held anywhere in one place.

Defined results: a null or empty text, or one whose joined A or B bytes are not the space and the text, has no tokens (zeros,
and an empty ``groups_sha256``); strings of special tokens inside a text are plain text; each row is aligned for itself, also
one that repeats another, and counts; a null id stays null; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_names
from .common import blocks, segment_sum, small_batches, staged

#: Bytes of text that are aligned at once, and bytes of text of a block.
BATCH_BYTES, BLOCK_BYTES = 2 << 20, 24 << 20
#: The pattern by which byte-level BPE files of this kind split a text (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What is known of a document before the corpus is counted.
DOCS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, " \
    "size binary, at binary, times binary, pair binary, total binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteBPE:
    """The JSON file's vocabulary and merges, run by tiktoken: there a pair's rank is the id of what it merges to, so the
    file's merges must make ids in ascending order.  What tiktoken can't take (it gives up on some very long runs) and
    files in another order go to the tokenizers library."""

    def __init__(self, text: str):
        import tiktoken

        spec = json.loads(text)
        self.text, self.slow = text, None
        model, byte = spec["model"], {c: b for b, c in enumerate(byte_names())}
        added = {t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*model["vocab"].values(), *added]) + 1)
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        ranks = {}
        for s, i in model["vocab"].items():
            if i not in added:
                self.bytes[i] = bytes(byte[c] for c in s)
                ranks[self.bytes[i]] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        plain = made == sorted(set(made)) and len(made) + 256 == len(ranks) and not spec.get("normalizer") and not model["ignore_merges"]
        before = spec["pre_tokenizer"]
        plain = plain and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
            except BaseException as e:  # the native code panics with an exception outside Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.by_library(text)

    def by_library(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.text)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]


class Batch:
    """Tokens of both sides of a batch of texts, their links and groups."""

    def __init__(self, texts: list[str | None], one: ByteBPE, two: Pieces):
        n = len(texts)
        some = [k for k, t in enumerate(texts) if t]
        both = {}
        for k, b in zip(some, two.encode([texts[k] for k in some]), strict=True):
            want = b" " + texts[k].encode()
            if b"".join(map(two.bytes.__getitem__, b.tolist())) == want:
                a = one.encode(" " + texts[k])
                if b"".join(map(one.bytes.__getitem__, a.tolist())) == want:
                    both[k] = (a, b)
        none = np.zeros(0, np.int32)
        own = [both.get(k, (none, none)) for k in range(n)]
        self.a, self.b = (np.concatenate([none, *[x[s] for x in own]]) for s in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[s]) for x in own], np.int64) for s in (0, 1))
        doc_a, doc_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        # both sides have the same bytes for each document: one scale of offsets for the batch
        end_a, end_b = (np.cumsum(np.array([len(x) for x in t.bytes], np.int64)[ids]) for t, ids in ((one, self.a), (two, self.b)))
        start_a, start_b = (np.concatenate([np.zeros(1, np.int64), e[:-1]])[:len(e)] for e in (end_a, end_b))
        left = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
        right = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
        cover_b = pd.merge_asof(left[["at", "doc"]], right, on="at", by="doc")["b"].to_numpy()
        cover_a = pd.merge_asof(right[["at", "doc"]], left, on="at", by="doc")["a"].to_numpy()
        inside = start_a[cover_a] != start_b  # else the pair is found from the A side
        self.link_a = np.concatenate([np.arange(len(self.a)), cover_a[inside]])
        self.link_b = np.concatenate([cover_b, np.flatnonzero(inside)])
        self.link_doc = np.concatenate([doc_a, doc_b[inside]])
        self.n_links = np.bincount(self.link_doc, minlength=n)
        # groups: runs of tokens up to an offset where both sides end
        self.last_a = end_b[np.minimum(np.searchsorted(end_b, end_a), max(0, len(end_b) - 1))] == end_a if len(end_b) else np.zeros(0, bool)
        self.last_b = end_a[np.minimum(np.searchsorted(end_a, end_b), max(0, len(end_a) - 1))] == end_b if len(end_a) else np.zeros(0, bool)
        self.n_groups = np.bincount(doc_a[self.last_a], minlength=n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's distinct id pairs (A id * 2^32 + B id), and their numbers: rows, pairs, numbers."""
        code = self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b].astype(np.int64)
        order = np.lexsort((code, self.link_doc))
        code, doc = code[order], self.link_doc[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))) if len(code) else np.zeros(0, np.int64)
        return doc[first], code[first], np.diff(np.append(first, len(code)))

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        ends_a, ends_b = np.flatnonzero(self.last_a), np.flatnonzero(self.last_b)
        group_a = np.cumsum(self.last_a) - self.last_a
        group_b = np.cumsum(self.last_b) - self.last_b
        before = np.concatenate([np.zeros(1, np.int64), ends_b + 1])  # B tokens of earlier groups
        ids = np.zeros(len(self.a) + len(self.b), np.int32)
        sign = np.full(len(ids), ord(","), np.uint8)
        place_a = np.arange(len(self.a)) + before[group_a]
        place_b = np.arange(len(self.b)) + (ends_a + 1)[group_b]
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a[self.last_a]], sign[place_b[self.last_b]] = ord("|"), ord(";")
        digits, width = decimals(int(ids.max()) + 1 if len(ids) else 1)
        chars, size = digits[ids], width[ids]
        chars[np.arange(len(ids)), size] = sign
        out = chars[np.arange(chars.shape[1]) <= size[:, None]].tobytes()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])[np.cumsum(self.n_a + self.n_b)].tolist()
        # the sign after a document's last group is left out
        return [hashlib.sha256(out[a:z - 1]).hexdigest() if z > a else "" for a, z in zip([0, *ends], ends, strict=False)]


_DECIMALS: list[tuple[np.ndarray, np.ndarray]] = []


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. n-1 (and room for a sign), and their widths."""
    if not _DECIMALS or len(_DECIMALS[0][1]) < n:
        names = [str(i).encode() for i in range(max(n, 1 << 16))]
        wide = len(names[-1]) + 1
        held = np.frombuffer(b"".join(x.ljust(wide) for x in names), np.uint8).reshape(-1, wide)
        _DECIMALS[:] = [(held, np.array([len(x) for x in names]))]
    return _DECIMALS[0]


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor().compress(np.ascontiguousarray(x).tobytes())


def unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


_LOADED: dict[int, tuple[ByteBPE, Pieces]] = {}


def _tokenizers(sent) -> tuple[ByteBPE, Pieces]:
    key = hash(sent.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = (ByteBPE(sent.value[0]), Pieces(sent.value[1]))
    return _LOADED[key]


def blocks_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each block of documents (columns ``id``, ``text``): their figures, each one's places among the block's
    distinct pairs, and these pairs with their numbers."""
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two vocabulary files, a few MB
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def row(number: int, held: list) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        one = [sum(map(list, columns[k]), []) for k in range(6)]
        size, code, times = (np.concatenate(columns[k]) for k in (6, 7, 8))
        pair, at = np.unique(code, return_inverse=True)
        total = np.bincount(at, weights=times, minlength=len(pair)).astype(np.int64)
        step = np.diff(at, prepend=0)  # within a document ascending
        values = [number, *one, packed(size.astype(np.int32)), packed(step.astype(np.int32)), packed(times.astype(np.int32)),
                  packed(np.diff(pair, prepend=0)), packed(total)]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _tokenizers(sent)
        number, held, bytes_ = TaskContext.get().partitionId() << 32, [], 0
        for b in blocks(batches, -1, BATCH_BYTES):
            texts = b.column(1).to_pylist()
            x = Batch(texts, one, two)
            doc, code, times = x.pairs()
            held.append((b.column(0).to_pylist(), x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), x.n_links.tolist(), x.digests(),
                         np.bincount(doc, minlength=len(texts)), code, times))
            bytes_ += b.column(1).nbytes
            if bytes_ >= BLOCK_BYTES:
                yield row(number, held)
                number, held, bytes_ = number + 1, [], 0
        if held:
            yield row(number, held)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, BLOCK)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' pairs as rows."""
    for b in batches:
        for block, pair, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
            pair = np.cumsum(unpacked(pair, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(unpacked(total, np.int64))], names=["block", "pair", "k"])


def _sums(own: pa.Table, counts: pa.Table) -> pa.Table:
    """Each document's sums over its links, of a block and the counts of its pairs."""
    out = []
    order = np.argsort(counts.column("pair").to_numpy(), kind="stable")
    count, best = counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
    for b in own.to_pylist():
        size = unpacked(b["size"], np.int32).astype(np.int64)
        at, times = np.cumsum(unpacked(b["at"], np.int32), dtype=np.int64), unpacked(b["times"], np.int32).astype(np.int64)
        first = np.cumsum(size) - size
        n_best, total = (segment_sum(v, first, size) for v in (times * best[at], times * count[at]))
        out.append(pa.table({"doc_id": pa.array(b["doc_id"], pa.int64()), **{c: pa.array(b[c], pa.int64()) for c in DOCS[1:5]}, "n_best": n_best, "count_sum": total,
                             "groups_sha256": pa.array(b["groups_sha256"], pa.string())}))
    return pa.concat_tables(out)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: tokens of both sides, groups, links, ``n_best`` (links whose count is the highest of their B id in the corpus),
    ``count_sum`` (of the links' counts) and ``groups_sha256``."""
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = staged(blocks_of(x, path_a, path_b), "token_blocks")
    pairs = staged(own.select("block", "pair", "total").mapInArrow(_pairs, "block long, pair long, k long"), "pairs")
    counts = pairs.groupBy("pair").agg(F.sum("k").alias("count"))
    most = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("most"))
    # a row for each id of B's vocabulary, whatever the corpus
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    back = pairs.select("block", "pair").join(counts, "pair").groupBy("block")
    return own.select("block", *DOCS, "size", "at", "times").groupBy("block").cogroup(back).applyInArrow(_sums, OUT)
