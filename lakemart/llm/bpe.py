"""Byte-pair encoding with a pair occurrence index.

The words of a batch that are not encoded yet are laid out end to end as symbols.  An index
maps each pair of neighbouring symbols to all its positions in the layout; a heap holds the
ranks of the pairs that occur.  The lowest active rank is taken, merged at all its positions
at once (as one array operation where they are many; a position whose symbols have changed
meanwhile is skipped), and the lists of the pairs that the merges create are updated.  Words never touch, so the order of
merges within a word is the usual one: lowest rank first.

Encoded words are kept between batches of a task, those in use longest, up to ``CACHE`` words.  Texts are read whole.

Defined results: null and empty texts have no tokens and decode to the empty string; the
strings of added tokens inside a text stand for those tokens; repeated rows are encoded each;
an empty table gives none; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, with_text

#: Words, and stretches of text without white space, whose encodings a task keeps: as many of
#: the last ones in use, and as many again of those in use before.
CACHE = 350_000
#: Positions from which on a pair is merged at all of them at once.
MANY = 48

# Fixed values of the file format: the white space of its patterns, small letters, its word
# pattern, and the printable stand-ins of the 256 bytes.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Capitals (and their small letters) that Python's Unicode tables do not know yet.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
         **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}


#: Letters and numbers of the regex module's Unicode version that are none in the file format's (16.0).
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F "
).split()


def word_pattern() -> str:
    """``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``, in the format's Unicode version."""
    ranges = [(r.split("-")[0], r.split("-")[-1]) for r in LATER]
    later = "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in ranges)
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{later}]]+|[\p{{N}}--[{later}]]|[[^{SPACE}\p{{L}}\p{{N}}]||[{later}]]+"


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def latin(text: str) -> bool:
    """Whether all characters are below U+0100 (much faster to tell than to search for others)."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Recent:
    """A bounded map: the last ``size`` entries in use, and the ones before them."""

    def __init__(self, size: int):
        self.size, self.now, self.past = size, {}, {}

    def get(self, keys: set[str], into: dict) -> list[str]:
        """Fill ``into``; returns the keys that are not held."""
        missing = []
        now, past = self.now, self.past
        for k in keys:
            if (v := now.get(k)) is None:
                if (v := past.get(k)) is None:
                    missing.append(k)
                    continue
                now[k] = v
            into[k] = v
        return missing

    def add(self, new: dict) -> None:
        self.now.update((k, v) for k, v in new.items() if len(k) <= 64)  # longer ones hardly come again
        if len(self.now) > self.size:
            self.now, self.past = {}, self.now


class WordBPE:
    """A tokenizer file (JSON) of kind BPE with a word-end suffix, lower case and byte level."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.ids | self.special).items()}
        #: pair -> (rank, merged symbol); a pair is one number, left * 2^20 + right
        self.rank: dict[int, tuple[int, int]] = {}
        self.pair: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merged = a + (b[len(model["continuing_subword_prefix"]):] if model["continuing_subword_prefix"] else b)
            self.pair.append(self.ids[a] << 20 | self.ids[b])
            self.rank[self.pair[-1]] = (r, self.ids[merged])
        names = byte_names()
        self.inner = np.array([self.ids.get(n, -1) for n in names])
        self.final = np.array([self.ids.get(n + self.suffix, -1) for n in names])
        spelled = {i: n.encode() + b" " for i, n in self.names.items()}
        self.width = np.array([len(spelled.get(i, b"")) for i in range(max(spelled) + 1)])
        wide = int(self.width.max())
        self.spelled = np.frombuffer(b"".join(spelled.get(i, b"").ljust(wide) for i in range(max(spelled) + 1)), np.uint8).reshape(-1, wide)
        codes = np.array(self.pair)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.words = regex.compile(word_pattern())
        self.space = re.compile(f"[{SPACE}]+")
        self.newer = re.compile("[" + "".join(map(chr, NEWER)) + "]")
        self.lead = {s[0] for s in self.special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept = Recent(CACHE)  # word or longer stretch -> (ids, decoded)

    # -- text to words ----------------------------------------------------------------

    def normal(self, text: str) -> str:
        """NFC, and each character lower-cased on its own; white space stays as it is."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would choose between two forms by position
            text = text.replace("Σ", "σ")
        if not latin(text) and self.newer.search(text):
            text = text.translate(NEWER)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Stretches of the normalised text without white space, added tokens apart.  Words
        never hold white space, so each stretch splits into words on its own."""
        if not any(c in text for c in self.lead) or len(parts := self.cut.split(text)) == 1:
            return self.stretches(text)
        out: list[str] = []
        for k, part in enumerate(parts):
            out.extend([part] if k % 2 else self.stretches(part))
        return out

    def stretches(self, text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to split(), not to the pattern
            return [p for p in self.space.sub(" ", self.normal(text)).split(" ") if p]
        return self.normal(text).split()

    # -- the pair occurrence index ----------------------------------------------------

    def layout(self, words: list[str]) -> np.ndarray:
        """The words' symbols end to end, -1 before, between and after: words never touch."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        out = np.full(len(data) + len(raw) + 1, -1)
        out[np.arange(len(data)) + np.repeat(np.arange(len(raw)), length) + 1] = symbol
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, end to end, and each word's bounds in them; by one index over all words.

        A pair with many positions is merged at all of them at once; one with few, position by position (the same arrays,
        seen as memory views).  Only positions of a pair of two equal symbols can overlap: these go left to right."""
        laid = self.layout(words)
        ends = np.flatnonzero(laid < 0) if len(words) else np.zeros(1, np.int64)
        if len(ends) != len(words) + 1:  # some byte is no symbol of this vocabulary: leave it out
            known = [[x for x in self.layout([w]).tolist() if x >= 0] for w in words]
            laid = np.array([-1, *(x for own in known for x in (*own, -1))])
            ends = np.concatenate([[0], np.cumsum([len(own) + 1 for own in known])]).astype(np.int64)
        size = len(laid)
        symbols, afters, befores = laid.astype(np.int64), np.arange(1, size + 1), np.arange(-1, size - 1)
        fresh = np.zeros(size + 1, bool)
        symbol, after, before = memoryview(symbols), memoryview(afters), memoryview(befores)
        places: dict[int, list] = {}  # rank of a pair -> all its positions: numbers, and arrays of numbers
        rank, by_rank, pop, push = self.rank.get, self.pair, heapq.heappop, heapq.heappush
        active: list[int] = []  # a heap of the ranks in the index

        def enter(codes: np.ndarray, at: np.ndarray) -> None:
            """Put the positions of these pairs into the index."""
            near = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            own = np.flatnonzero(self.codes[near] == codes)
            ranks, at = self.order[near[own]], at[own]
            by = np.argsort(ranks, kind="stable")
            ranks, at = ranks[by], at[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = np.append(0, cuts)[:len(ranks)].tolist()
            flat = at.tolist()
            for r, a, z in zip(ranks[starts].tolist(), starts, [*cuts.tolist(), len(flat)], strict=False):
                if r not in places:
                    places[r] = []
                    push(active, r)
                if z - a < MANY:
                    places[r].extend(flat[a:z])
                else:
                    places[r].append(at[a:z])

        enter(np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] << 20 | symbols[1:], -1), np.arange(size - 1))
        while active:
            lowest = pop(active)
            held = places.pop(lowest)
            pair = by_rank[lowest]
            left, right = pair >> 20, pair & 0xFFFFF
            merged = rank(pair)[1]
            arrays = [x for x in held if type(x) is not int]
            if left != right and (arrays or len(held) >= MANY):
                at = np.concatenate([*arrays, np.array([x for x in held if type(x) is int], np.int64)])
                at = at[(symbols[at] == left) & (symbols[afters[at]] == right)]
                nxt = afters[at]
                beyond = afters[nxt]
                symbols[at], symbols[nxt] = merged, -2
                afters[at], befores[beyond] = beyond, at
                fresh[at] = True
                other = symbols[beyond]
                prev = befores[at]
                behind = symbols[prev]
                from_left = (behind >= 0) & ~fresh[prev]  # a neighbour merged just now has the pair as its own right side
                fresh[at] = False
                ahead = other >= 0
                enter(np.concatenate([merged << 20 | other[ahead], behind[from_left] << 20 | merged]), np.concatenate([at[ahead], prev[from_left]]))
                continue
            if arrays:
                held = [x for x in held if type(x) is int] + [x for a in arrays for x in a.tolist()]
            if left == right:
                held.sort()
            for at in held:
                nxt = after[at]
                if symbol[at] != left or symbol[nxt] != right:
                    continue
                beyond, prev = after[nxt], before[at]
                symbol[at], symbol[nxt] = merged, -2
                after[at] = beyond
                before[beyond] = at
                other = symbol[beyond]
                if other >= 0 and (found := rank(merged << 20 | other)):
                    if found[0] in places:
                        places[found[0]].append(at)
                    else:
                        places[found[0]] = [at]
                        push(active, found[0])
                other = symbol[prev]
                if other >= 0 and (found := rank(other << 20 | merged)):
                    if found[0] in places:
                        places[found[0]].append(prev)
                    else:
                        places[found[0]] = [prev]
                        push(active, found[0])
        keep = np.flatnonzero(symbols >= 0)
        return symbols[keep], np.searchsorted(keep, ends)

    # -- batches ----------------------------------------------------------------------

    def learn(self, pieces: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Of each stretch its ids (little-endian unsigned 32 bit), and its decoded UTF-8."""
        got: dict[str, tuple[bytes, bytes]] = {}
        missing = self.kept.get(pieces, got)
        split = {p: own for p in missing if not p.isalpha() and p not in self.special and len(own := self.words.findall(p)) > 1}
        parts = {w for own in split.values() for w in own}
        plain = [p for p in missing if p not in split and p not in self.special]
        plain += self.kept.get(parts - got.keys() - set(plain), got)
        fresh = {p: (struct.pack("<I", self.special[p]), p.encode()) for p in missing if p in self.special}
        ids, cuts = self.merge(plain)
        codes, text = ids.astype("<u4").tobytes(), self.spelled[ids]
        size = self.width[ids]
        # every name and a space, end to end; a word's ends before its last space
        text = text[np.arange(text.shape[1]) < size[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[cuts].tolist()
        cuts = (4 * cuts).tolist()
        for w, a, z, b, y in zip(plain, cuts, cuts[1:], upto, upto[1:], strict=False):
            fresh[w] = (codes[a:z], text[b:y - 1] if y > b else b"")
        got |= fresh
        for p, own in split.items():
            both = [got[w] for w in own]
            fresh[p] = got[p] = (b"".join([x[0] for x in both]), b" ".join([x[1] for x in both if x[1]]))
        self.kept.add(fresh)
        return {p: got[p][0] for p in pieces}, {p: got[p][1] for p in pieces}

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text its ids and its decoded UTF-8."""
        split = [self.pieces(t) if t else [] for t in texts]
        ids, decoded = self.learn(set().union(*split))
        blank = any(not d for d in decoded.values())  # a word of which no byte is in the vocabulary
        for own in split:
            out = map(decoded.__getitem__, own)
            yield b"".join(map(ids.__getitem__, own)), b" ".join(filter(None, out) if blank else out)

    def decode(self, ids) -> str:
        """As the file's decoder does it: none is named, so token strings joined by a space."""
        return " ".join(self.names[int(i)] for i in ids if int(i) in self.names)


_LOADED: dict[int, WordBPE] = {}


def load(spark, path: str):
    """The tokenizer file's contents for the tasks (a vocabulary file: a few MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _tokenizer(sent) -> WordBPE:
    key = hash(sent.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBPE(json.loads(sent.value))
    return _LOADED[key]


#: Bytes of text that are encoded together.
GROUP_BYTES = 4 << 20


def encode(df: DataFrame, path: str, text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Append each text's ``ids`` and ``decoded`` text (where asked for), their number and
    SHA-256 digests: ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit
    numbers), ``decoded_sha256``.  Input columns of these names are replaced."""
    sent = load(df.sparkSession, path)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    added += [T.StructField("decoded", T.StringType())] if decoded else []
    added += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    out = T.StructType(kept + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(sent)
        for batch in batches:
            texts = batch.column(-1).to_pylist()
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= GROUP_BYTES):
                    size += len(texts[upto] or "")
                    upto += 1
                codes, strings = zip(*bpe.encode_batch(texts[at:upto]), strict=True)
                counts = np.array([len(c) // 4 for c in codes], np.int64)
                columns = [c.slice(at, upto - at) for c in batch.columns[:-1]]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), "<i4"))))
                if decoded:
                    columns.append(pa.array([b.decode() for b in strings], pa.string()))
                columns += [pa.array(counts), pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                            pa.array([hashlib.sha256(b).hexdigest() for b in strings], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])
                at = upto

    small_batches(df.sparkSession)
    return with_text(df, kept, text_col).mapInArrow(run, out)
