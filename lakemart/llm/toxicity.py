"""Toxic spans and document scores by a conditional random field over words.

``train`` learns from a bounded sample of labelled texts (``PER_LABEL`` of each label, each of
at most ``langid.LONGEST`` characters).  Documents are labelled, words are not, so the words
are labelled first: words and word beginnings that many toxic and hardly any clean texts hold
are taken greedily until each toxic text holds ``COVER`` of them; words of toxic texts that
match are toxic, all others are not.  The field learns from these, its own marginals then add
toxic words of toxic texts, and it learns once more.

``scan`` tags every word by forward-backward; words with a marginal of at least one half join
to offending spans, and a logistic function of the marginals (their sum, the two greatest, and
the share of the text), fitted on the sample, is the document's score.

Defined results: null and empty texts, and texts without letters, have no span and the score of
a text without toxic words; with no toxic or no clean labelled text to learn from, every score
is the share of toxic labels (0 without labels); several labels of one id are each learned from;
repeated rows are each scored; an empty table gives none; other columns are kept, but for the
result's own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, small_batches, texts_of, with_text
from .crf import Block, Crf
from .langid import TEXTS, held_out, pick

#: Training sample: texts of each label.
PER_LABEL = 1200
#: Toxic patterns that each toxic training text is to hold.
COVER = 3
BEGINNINGS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


class Model:
    """The field, and the logistic function from its marginals to a score."""

    def __init__(self, share: float):
        self.share = share
        self.crf: Crf | None = None
        self.center = self.scale = self.weight = np.zeros(0)
        self.bias = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.crf is None:
            return np.full(len(features), self.share)
        return 1 / (1 + np.exp(-np.clip(((features - self.center) / self.scale) @ self.weight + self.bias, -30, 30)))


def patterns(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Words and beginnings (marked by a final ``*``) that tell toxic texts: greedily the one in
    most texts not yet covered ``COVER`` times, if it is ten times rarer among clean texts."""
    def held(words: list[str]) -> set[str]:
        own = set(words)
        return own | {f"{w[:k]}*" for w in own for k in BEGINNINGS if len(w) > k}

    sets = [held(t) for t in toxic]
    rare = Counter()
    for t in clean:
        rare.update(held(t))
    count = Counter()
    for s in sets:
        count.update(s)
    ratio = len(toxic) / max(1, len(clean))
    least = max(4, len(toxic) // 250)
    fit = {p for p, n in count.items() if n >= least and n >= 10 * rare[p] * ratio}
    where: dict[str, list[int]] = {}
    for k, s in enumerate(sets):
        for p in s & fit:
            where.setdefault(p, []).append(k)
    covered = [0] * len(sets)
    chosen: set[str] = set()
    left = {p: len(v) for p, v in where.items()}
    while left:
        best = max(left, key=lambda p: (left[p] - 10 * rare[p] * ratio, len(p), p))
        if left[best] < least:
            break
        del left[best]
        if any(best.startswith(c[:-1]) for c in chosen if c.endswith("*")):
            continue  # told already by a shorter beginning
        chosen.add(best)
        for k in where[best]:
            covered[k] += 1
            if covered[k] == COVER:
                for p in sets[k] & fit:
                    if p in left:
                        left[p] -= 1
    return chosen


def matches(word: str, chosen: set[str]) -> bool:
    return word in chosen or any(f"{word[:k]}*" in chosen for k in BEGINNINGS if len(word) > k)


def features(block: Block, marginal: np.ndarray, n: int) -> np.ndarray:
    """Of each text: log(1 + sum), the greatest and second greatest marginal, and the sum's
    share of the words.  The sum leaves out marginals below 0.3, which add up in long texts."""
    w = block.words
    total = np.bincount(w.doc, weights=np.where(marginal >= 0.3, marginal, 0), minlength=n) if block.n else np.zeros(n)
    padded = np.concatenate([marginal, [0.0]])
    order = np.lexsort((-marginal, w.doc)) if block.n else np.zeros(0, np.int64)
    last = len(order)
    first = np.where(w.count > 0, w.first, last)
    second = np.where(w.count > 1, w.first + 1, last)
    ranked = np.append(order, last)
    return np.stack([np.log1p(total), padded[ranked[first]], padded[ranked[second]], total / np.maximum(w.count, 1)], axis=1)


def train(got: list[tuple[str, str]], share: float = 0.0) -> Model:
    """From (label, text) rows with labels "0" and "1"."""
    model = Model(share)
    rows = list(dict.fromkeys(got))  # copies teach nothing new
    words = [WORD.findall(t.lower()) for _, t in rows]
    toxic = [w for (x, _), w in zip(rows, words, strict=True) if x == "1"]
    clean = [w for (x, _), w in zip(rows, words, strict=True) if x == "0"]
    if not toxic or not clean:
        return model
    chosen = patterns(toxic, clean)
    order = np.random.default_rng(11).permutation(len(rows))
    learned, y = [], []
    for k in range(0, len(order), TEXTS):
        part = [rows[i] for i in order[k:k + TEXTS]]
        block = Block(pa.array([t for _, t in part], pa.string()))
        w = block.words
        is_toxic = np.array([x == "1" for x, _ in part])
        first = np.zeros(len(block.key), np.int64)
        first[block.word[::-1]] = np.arange(block.n)[::-1]
        hit = np.array([matches(w.data[w.start[i]:w.end[i]].tobytes().decode(), chosen) for i in first], dtype=bool)
        label = hit[block.word] & is_toxic[w.doc]
        learned.append([block, label.astype(np.int64)])
        y.append(is_toxic)
    for again in range(2):
        crf = Crf(["clean", "toxic"])
        crf.list_words(learned, least=3)
        crf.learn(learned, rounds=5)
        if not again:  # more toxic words, in toxic texts only
            for pair, is_toxic in zip(learned, y, strict=True):
                block, label = pair
                pair[1] = np.maximum(label, ((crf.marginals(block)[:, 1] >= 0.5) & is_toxic[block.words.doc]).astype(np.int64))
    model.crf = crf
    x = np.concatenate([features(b, crf.marginals(b)[:, 1].astype(float), len(t)) for (b, _), t in zip(learned, y, strict=True)])
    target = np.concatenate(y).astype(float)
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - model.center) / model.scale, np.ones(len(x))])
    weight = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6]) * len(x) * 0.01
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        weight -= np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (p - target) + ridge @ weight)
    model.weight, model.bias = weight[:-1], float(weight[-1])
    return model


def spans(block: Block, marginal: np.ndarray, n: int) -> list[list[dict]]:
    """Offending stretches of each text in code points [start, end), with their greatest marginal."""
    w = block.words
    out: list[list[dict]] = [[] for _ in range(n)]
    hit = np.flatnonzero(marginal >= 0.5)
    if not len(hit):
        return out
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    for i in hit:
        d = w.doc[i]
        begin = points[w.offsets[d]]
        start, end, p = int(points[w.start[i]] - begin), int(points[w.end[i]] - begin), float(marginal[i])
        own = out[d]
        if own and i and hit_before(own, start):
            own[-1]["end"], own[-1]["p"] = end, max(own[-1]["p"], p)
        else:
            own.append({"start": start, "end": end, "p": p})
    return out


def hit_before(own: list[dict], start: int) -> bool:
    """Whether the last span ends right before: one space or mark between."""
    return start - own[-1]["end"] <= 1


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Append ``score``, ``predicted`` (1 from a score of one half on) and ``spans``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    own = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPAN)]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in own}]
    out = T.StructType([*kept, *own])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in blocks(batches, -1):
            texts = texts_of(batch.column(-1))
            n = len(texts)
            if own.crf is None:
                score, found = np.full(n, own.share), [[] for _ in range(n)]
            else:
                block = Block(texts)
                marginal = own.crf.marginals(block)[:, 1].astype(float)
                score, found = own.score(features(block, marginal, n)), spans(block, marginal, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32()),
                                              pa.array(found, arrow)], names=[f.name for f in out.fields])

    small_batches(docs.sparkSession)
    return with_text(docs, kept, text_col).mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """Learn from the labels of rows that are not held out, and score all rows."""
    known = labels.where(~held_out(id_col, 5, 0))
    share = known.select(F.avg(F.col(label).cast("double"))).first()[0]
    got = pick(few(docs, known, label, id_col, text_col, PER_LABEL), PER_LABEL)
    rows = docs.select(F.col(id_col), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    return scan(rows, train(got, share or 0.0)).select(id_col, "held_out", "score", "predicted", "spans")


def few(docs: DataFrame, known: DataFrame, label: str, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """``label``, ``at`` and ``text`` of the labelled ids that can come into the sample: somewhat
    more ids of each label than it takes are chosen by hash (at most four times ``per_label`` in
    all), and only these, a bounded number, are sent to the tasks that read the texts."""
    x = known.select(F.col(id_col).alias("id"), F.col(label).cast("int").cast("string").alias("label")).where("label in ('0', '1') and id is not null")
    x = x.withColumn("at", F.pmod(F.xxhash64(F.lit(20240229), F.col("id")), F.lit(1 << 30)))
    counts = {r["label"]: r["count"] for r in x.groupBy("label").count().collect()}
    keep = F.lit(False)
    for own, n in counts.items():
        keep = keep | ((F.col("label") == own) & (F.col("at") < min(1 << 30, int((1 << 30) * 1.3 * per_label / n) + 1)))
    chosen = x.where(keep).orderBy("at", "id", "label").limit(4 * per_label)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
