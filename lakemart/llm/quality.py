"""Quality of texts by attention-based multiple-instance learning.

A text is a bag of passages: its lines, longer ones cut every ``PASSAGE`` words.  Each passage
is encoded from measurements of its bytes and words; gated attention (a softmax over the
passages of ``w . (tanh(V h) * sigmoid(U h))``), learned from document labels alone, weighs the
passages, and the weighted representation is scored.  All weights are learned together by
gradient descent on a bounded sample (``PER_LABEL`` texts of each label, each of at most
``langid.LONGEST`` characters).

Defined results: a null or empty text is one empty passage and gets its score; with labels of
one kind only, every score is that share (without any label one half); several labels of one id
are each learned from; repeated rows are each scored; an empty table gives none; other columns
are kept, but for the result's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import M1, Words, blocks, mix, small_batches, texts_of, with_text
from .langid import held_out, pick
from .toxicity import few

#: Training sample: texts of each label.
PER_LABEL = 1500
#: Words of a passage at most.
PASSAGE = 48
HIDDEN, GATES = 16, 8

VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False


def _classes() -> np.ndarray:
    """Of each byte its class, 0 to 7: other, lower, upper, digit, stop, exclamation, symbol,
    beyond ASCII."""
    out = np.zeros(256, np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 7
    out[list(b".,;:'-")] = 4
    out[list(b"!?")] = 5
    out[list(b"#$%&*|@^~+=<>/\\_{}[]")] = 6
    return out


CLASS = _classes()
CLASSES = 8


class Passages:
    """Measurements of the passages of a block of texts; every text has at least one."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, VISIBLE, lower=False)
        n, size = len(texts), len(w.start)
        lines = np.concatenate([[0], np.cumsum(w.data == 10)])
        new = np.ones(size, dtype=bool)
        new[1:] = (w.doc[1:] != w.doc[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1]])
        line = np.flatnonzero(new)
        within = np.arange(size) - np.repeat(line, np.diff(np.append(line, size)))
        new |= within % PASSAGE == 0
        first = np.flatnonzero(new)
        words = np.diff(np.append(first, size))
        passage = np.repeat(np.arange(len(first)), words)
        # by class of byte, over the words of a passage
        where = np.concatenate([[0], w.end[first[1:] - 1], w.end[-1:]]) if size else np.zeros(1, np.int64)
        kind = CLASS[w.data]
        share = np.empty((len(first), CLASSES))
        for k in range(CLASSES):
            share[:, k] = np.diff(np.concatenate([[0], np.cumsum(kind == k)])[where]) if size else 0
        total = np.maximum(share[:, 1:].sum(axis=1), 1)
        length = (w.end - w.start).astype(float)
        starts, ends = w.data[w.start], w.data[w.end - 1]
        again = np.zeros(size)
        again[1:] = (w.key[1:] == w.key[:-1]) & ~new[1:]
        _, seen = np.unique(mix(w.key + passage.astype(np.uint64) * M1), return_index=True)

        def mean(x):
            return np.add.reduceat(x.astype(float), first) / words if size else np.zeros(0)

        own = [share[:, k] / total for k in range(1, CLASSES)]
        own += [np.log1p(words), np.log1p(total), mean(length), np.sqrt(np.maximum(mean(length ** 2) - mean(length) ** 2, 0)),
                mean(length == 1), mean(length > 14), np.log1p(mean(length.clip(max=500))), mean(again),
                np.bincount(passage[seen], minlength=len(first)) / np.maximum(words, 1),
                mean((starts >= 65) & (starts < 91)), mean(CLASS[ends] == 4), mean(CLASS[ends] == 5), mean(CLASS[ends] == 6),
                mean((length == 1) & (CLASS[starts] == 6)), mean((CLASS[starts] == 2) & (CLASS[ends] == 2) & (length > 1))]
        x = np.stack(own, axis=1) if own else np.zeros((0, 22))
        doc = w.doc[first]
        blank = np.flatnonzero(w.count == 0)  # texts without words: one passage of zeros
        doc = np.concatenate([doc, blank])
        order = np.argsort(doc, kind="stable")
        self.x = np.concatenate([x, np.zeros((len(blank), x.shape[1]))])[order]
        self.doc = doc[order]
        self.first = np.searchsorted(self.doc, np.arange(n))
        self.n = n


def softmax(e: np.ndarray, p: Passages) -> np.ndarray:
    """Over the passages of each text."""
    e = np.exp(e - np.maximum.reduceat(e, p.first)[p.doc])
    return e / np.add.reduceat(e, p.first)[p.doc]


class Model:
    """h = tanh(W x + b); a = softmax(w . (tanh(V h) * sigmoid(U h))); score = sigmoid(u . sum(a h) + c)."""

    def __init__(self, share: float):
        self.share = share
        self.weights: dict[str, np.ndarray] | None = None
        self.center = self.scale = np.zeros(0)

    def forward(self, p: Passages):
        k = self.weights
        x = (p.x - self.center) / self.scale
        h = np.tanh(x @ k["W"] + k["b"])
        v, u = np.tanh(h @ k["V"]), 1 / (1 + np.exp(-(h @ k["U"])))
        a = softmax((v * u) @ k["w"], p)
        z = np.add.reduceat(a[:, None] * h, p.first, axis=0)
        return x, h, v, u, a, z, z @ k["u"] + k["c"]

    def score(self, p: Passages) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its score, of each passage its attention."""
        if self.weights is None:
            return np.full(p.n, self.share), 1 / np.bincount(p.doc, minlength=p.n)[p.doc]
        *_, a, _, logit = self.forward(p)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), a

    def learn(self, parts: list[tuple[Passages, np.ndarray]], rounds: int = 60, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Adam on the cross-entropy of the document labels."""
        rng = np.random.default_rng(5)
        every = np.concatenate([p.x for p, _ in parts])
        self.center, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-6
        d = every.shape[1]
        k = self.weights = {"W": rng.normal(0, d ** -0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.25, (HIDDEN, GATES)),
                            "U": rng.normal(0, 0.25, (HIDDEN, GATES)), "w": rng.normal(0, 0.25, GATES), "u": rng.normal(0, 0.25, HIDDEN), "c": np.zeros(1)}
        m1, m2 = {n: np.zeros_like(v) for n, v in k.items()}, {n: np.zeros_like(v) for n, v in k.items()}
        t = 0
        for _ in range(rounds):
            for j in rng.permutation(len(parts)):
                p, y = parts[j]
                x, h, v, u, a, z, logit = self.forward(p)
                e = (1 / (1 + np.exp(-logit)) - y) / p.n
                gz = e[:, None] * k["u"]
                ga = (gz[p.doc] * h).sum(axis=1)
                gs = a * (ga - np.add.reduceat(a * ga, p.first)[p.doc])  # through the softmax
                gv, gu = gs[:, None] * u * k["w"] * (1 - v ** 2), gs[:, None] * v * k["w"] * u * (1 - u)
                gh = (a[:, None] * gz[p.doc] + gv @ k["V"].T + gu @ k["U"].T) * (1 - h ** 2)
                grad = {"W": x.T @ gh, "b": gh.sum(axis=0), "V": h.T @ gv, "U": h.T @ gu, "w": (v * u).T @ gs, "u": z.T @ e, "c": e.sum(keepdims=True)}
                t += 1
                for n, g in grad.items():
                    g = g + decay * k[n]
                    m1[n] = 0.9 * m1[n] + 0.1 * g
                    m2[n] = 0.999 * m2[n] + 0.001 * g * g
                    k[n] = k[n] - rate * (m1[n] / (1 - 0.9 ** t)) / (np.sqrt(m2[n] / (1 - 0.999 ** t)) + 1e-8)


def train(got: list[tuple[str, str]], share: float | None, texts: int = 128) -> Model:
    """From (label, text) rows with labels "0" and "1"; ``share``: of label 1 among all labelled
    rows, which the sample does not keep."""
    model = Model(0.5 if share is None else share)
    labels = {x for x, _ in got}
    if labels != {"0", "1"}:
        return model
    order = np.random.default_rng(3).permutation(len(got))
    parts = []
    for k in range(0, len(order), texts):
        rows = [got[i] for i in order[k:k + texts]]
        parts.append((Passages(pa.array([t for _, t in rows], pa.string())), np.array([float(x) for x, _ in rows])))
    model.learn(parts)
    ones = sum(x == "1" for x, _ in got) / len(got)
    if 0 < model.share < 1:  # back from the sample's shares to all rows'
        model.weights["c"] = model.weights["c"] + np.log(model.share / (1 - model.share)) - np.log(ones / (1 - ones))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", explain: bool = False) -> DataFrame:
    """Append ``score``, ``predicted`` (1 from one half on) and, with ``explain``, each passage's
    ``attention``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    own = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    own += [T.StructField("attention", T.ArrayType(T.DoubleType()))] * explain
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in own}]
    out = T.StructType([*kept, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, -1):
            p = Passages(texts_of(batch.column(-1)))
            s, a = sent.value.score(p)
            columns = [*batch.columns[:-1], pa.array(s, pa.float64()), pa.array(s >= 0.5).cast(pa.int32())]
            if explain:
                columns.append(pa.array(np.split(a, p.first[1:]), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    small_batches(docs.sparkSession)
    return with_text(docs, kept, text_col).mapInArrow(run, out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    """Learn from the labels of ids that are not held out."""
    known = labels.where(~held_out(id_col, 3, 1) & F.col(label).isin(0, 1))
    share = known.select(F.avg(F.col(label).cast("double"))).first()[0]
    got = pick(few(docs, known, label, id_col, text_col, PER_LABEL), PER_LABEL)
    return train(got, share)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """Learn from the labels of rows that are not held out, and score all rows."""
    model = fit(docs, labels, id_col, text_col, label)
    rows = docs.select(F.col(id_col), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, model).select(id_col, "held_out", "score", "predicted")
