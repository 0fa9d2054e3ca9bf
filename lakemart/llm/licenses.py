"""License scan by patience alignment.

``align`` anchors on words that occur once in the text and once in the template, keeps the
longest run of anchors that ascends in both (longest increasing subsequence), and aligns each
gap between anchors in the same way; where a gap has no such word, equal words at its two ends
are matched.  The share of the template's words that are matched is its coverage.

``scan`` finds, over a block of texts at once, the places of each template's words of at least
``LONG`` letters and of the phrases that tell its license from others (``license_texts``: name,
version, variant).  A text that lacks more of these words than ``coverage`` leaves unmatched,
or a phrase, cannot hold the template and is passed over; in others, windows of the template's
length around the phrase, or the words where it has none, are aligned.  Matches of at least
``coverage`` that hold each phrase whole are kept, of overlapping ones the one with most
matched words.

Defined results: null, empty and wordless texts hold no license; every copy of a notice in a
text is found; ties go to the template first in order of name; repeated rows are each scanned;
an empty table or no templates give no match; other columns are kept, but for the result's own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, blocks, small_batches, texts_of, with_text
from .decontam import WORD
from .license_texts import TELLING, TEMPLATES

COVERAGE, LONG = 0.75, 5


def increasing(values: Sequence[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = v, k
    out = []
    k = top_at[-1] if top_at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(text: Sequence, template: Sequence) -> list[tuple[int, int]]:
    """Matched (text, template) positions, ascending in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {w: k for k, w in enumerate(template[c:d], c) if there[w] == 1 and here.get(w) == 1}
        common = [(k, at[w]) for k, w in enumerate(text[a:b], a) if w in at]
        if not common:
            while a < b and c < d and text[a] == template[c]:
                out.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and text[b - 1] == template[d - 1]:
                b, d = b - 1, d - 1
                out.append((b, d))
            continue
        anchors = [common[k] for k in increasing([y for _, y in common])]
        out += anchors
        for (x, y), (u, v) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            gaps.append((x + 1, u, y + 1, v))
    return sorted(out)


def places(words: Sequence, phrase: Sequence) -> list[int]:
    """Where a phrase stands whole."""
    n = len(phrase)
    return [k for k, w in enumerate(words) if w == phrase[0] and list(words[k:k + n]) == phrase]


class Template:
    def __init__(self, name: str, text: str, coverage: float, phrases: Sequence[str] = ()):
        w = Words(pa.array([text], pa.string()), WORD)
        self.name = name
        self.words = w.key.tolist()
        self.coverage = coverage
        #: per phrase its forms, each a list of words
        self.phrases = [[Words(pa.array([f], pa.string()), WORD).key.tolist() for f in p.split("|")] for p in phrases]
        self.offsets = places(self.words, self.phrases[0][0]) if phrases else []
        if phrases and not self.offsets:
            raise ValueError(f"{name}: its first phrase is not in its text")
        size = len(self.words)
        spare = size - next((n for n in range(size + 1) if n >= coverage * size), size)  # words that may go unmatched
        long = (w.end - w.start) >= LONG
        if int(long.sum()) <= spare:  # too few to be missed
            long = np.ones(size, bool)
        #: telling words, and how many of them (each as often as the template has it) a text has at least
        self.telling = Counter(w.key[long].tolist())
        self.least = int(long.sum()) - spare
        self.first = {k: i for i, k in reversed(list(enumerate(self.words)))}
        self.vocabulary = {*self.telling, *(k for p in self.phrases for f in p for k in f)}

    def possible(self, held: set[int]) -> bool:
        """Whether a text of these words may hold the template; no match is lost."""
        return all(any(held.issuperset(f) for f in p) for p in self.phrases) \
            and sum(self.telling[k] for k in held & self.telling.keys()) >= self.least


def matches(words: list[int], hits: Sequence[int], t: Template) -> list[tuple[int, int, float, int]]:
    """(first word, end, coverage, matched words) of each copy of a template, in order; ``hits``:
    places of its telling words."""
    out = []
    size = len(t.words)
    slack = max(2, size // 4)
    end = 0
    if t.phrases:
        hits = sorted({k for f in t.phrases[0] for k in places(words, f)})
    for p in hits:
        if p < end:
            continue
        low, high = (t.offsets[0], t.offsets[-1]) if t.phrases else (t.first[words[p]], t.first[words[p]])
        begin = max(end, p - high - slack)
        stop = min(len(words), p - low + size + slack)
        got = align(words[begin:stop], t.words)
        if got and len(got) >= t.coverage * size:
            a, b = begin + got[0][0], begin + got[-1][0] + 1
            # with as many words as the template goes on at its ends: another form of a phrase may stand there
            near = words[max(begin, a - got[0][1]):min(stop, b + size - 1 - got[-1][1])]
            if all(any(places(near, f) for f in forms) for forms in t.phrases):
                out.append((a, b, len(got) / size, len(got)))
                end = b
    return out


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                                  T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan_block(texts: pa.Array, templates: Sequence[Template]) -> list[list[dict]]:
    w = Words(texts, WORD)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(w.key):
        return out
    telling = np.array(sorted(set().union(*[t.vocabulary for t in templates])), np.uint64)
    if not len(telling):
        return out
    at = np.minimum(np.searchsorted(telling, w.key), len(telling) - 1)
    hit = np.flatnonzero(telling[at] == w.key)
    if not len(hit):
        return out
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    cuts = np.flatnonzero(np.diff(w.doc[hit])) + 1
    for own in np.split(hit, cuts):
        d = int(w.doc[own[0]])
        held = set(w.key[own].tolist())
        words = None
        found = []
        for t in templates:
            if not t.possible(held):
                continue
            if words is None:
                first = int(w.first[d])
                words = w.key[first:first + int(w.count[d])].tolist()
            hits = [] if t.phrases else [k - first for k in own.tolist() if words[k - first] in t.telling]
            found += [(-n, t.name, s, e, c) for s, e, c, n in matches(words, hits, t)]
        taken: list[tuple[int, int]] = []
        for n, name, s, e, c in sorted(found):
            if all(e <= x or s >= y for x, y in taken):
                taken.append((s, e))
                begin = points[w.offsets[d]]
                out[d].append({"license": name, "coverage": c, "start": int(points[w.start[first + s]] - begin), "end": int(points[w.end[first + e - 1]] - begin)})
        out[d].sort(key=lambda m: m["start"])
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text_col: str = "text", coverage: float = COVERAGE,
         telling: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Append ``found``: each notice's license, coverage and place in code points [start, end),
    in order of place.  ``telling``: phrases by template, those of ``license_texts`` unless given."""
    kept = [f for f in docs.schema.fields if f.name != "found"]
    out = T.StructType([*kept, T.StructField("found", FOUND)])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    texts = dict(sorted(templates.items()))
    phrases = dict(telling) if telling is not None else {k: TELLING[k] for k, v in texts.items() if k in TELLING and v == TEMPLATES.get(k)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [t for t in (Template(k, v, coverage, phrases.get(k, ())) for k, v in texts.items()) if t.words]
        for batch in blocks(batches, -1):
            found = scan_block(texts_of(batch.column(-1)), own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow)], names=[f.name for f in out.fields])

    small_batches(docs.sparkSession)
    return with_text(docs, kept, text_col).mapInArrow(run, out)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the number of notices, the first one's license, coverage and place, and all licenses."""
    first = F.try_element_at("found", F.lit(1))
    return found.select(id_col, F.size("found").alias("n_found"), first["license"].alias("license"), first["coverage"].alias("coverage"),
                        first["start"].alias("start"), first["end"].alias("end"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"]))), ",").alias("licenses"))
