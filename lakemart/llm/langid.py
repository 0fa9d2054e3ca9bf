"""Language of a text by a conditional random field that labels each word, so that
code-switched text is labelled word by word.

``train`` learns from a bounded sample of labelled texts (``PER_LANGUAGE`` of each language,
fewer where so many would be more than ``ROWS_AT_ALL``, but at least one; of a text longer than
``LONGEST`` a window at a pseudo-random place): every word carries its text's language, and some
chains are spliced from two languages so that switches have been seen.  ``tag`` gives each
word's language and probability, ``predict`` sums the words' marginals over a text.

Every language with a labelled row is learned, up to ``LANGUAGES``, which is more than there are
codes of languages.  Defined results: a null text, or one without letters, is ``und`` with score 0, and so is every
text where nothing could be learned (no labelled rows); a tie goes to the label first in order;
repeated rows are each predicted; an empty table gives none; other columns are kept, but for
the result's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, blocks, doc_hash, small_batches, texts_of, with_text
from .crf import Block, Crf

#: Training sample: texts of each language, characters of a text, and texts at all.
PER_LANGUAGE = 300
LONGEST = 20_000
ROWS_AT_ALL = 20_000
#: Languages that are told apart at most (ISO 639-3 has fewer); a bound on the model's size.
LANGUAGES = 8192
#: Words times languages that are scored at once.
CELLS = 1 << 24
#: Texts of a training block.
TEXTS = 100


def sample(rows: DataFrame, label: str, text: str, per_label: int, order: Column, labels: int = LANGUAGES,
           at_all: int = ROWS_AT_ALL) -> list[tuple[str, str]]:
    """About ``per_label`` rows of each label in a fixed pseudo-random order, or at least one of
    each where that many were more than ``at_all``: so many texts of at most ``LONGEST``
    characters reach the driver, however many rows there are."""
    x = rows.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"), F.pmod(order, F.lit(1 << 30)).alias("at")) \
        .where("label is not null and text is not null")
    counts = x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least")).orderBy(F.desc("n"), "label").limit(labels).collect()
    per = min(per_label, max(1, at_all // max(1, len(counts))))
    # a label's first rows: those below what about 1.3 times as many pass, and its very first
    known = rows.sparkSession.createDataFrame([(r["label"], r["least"], min(1 << 30, int((1 << 30) * (1.3 * per + 4) / r["n"]) + 1)) for r in counts],
                                              "label string, least long, upto long")
    chosen = x.join(F.broadcast(known), "label").where("at < upto or at = least")  # at most LANGUAGES rows
    longer = F.greatest(F.length("text") - LONGEST, F.lit(0))
    window = F.substring(F.col("text"), F.pmod("at", longer + 1).cast("int") + 1, F.lit(LONGEST))
    return pick(chosen.select("label", "at", window.alias("text")).distinct(), per)


def pick(rows: DataFrame, per_label: int) -> list[tuple[str, str]]:
    """Of few rows (``label``, ``at``, ``text``) the first ``per_label`` of each label."""
    got = sorted((r["label"], r["at"], r["text"]) for r in rows.where(F.length("text") <= LONGEST).select("label", "at", "text").collect())
    out, n = [], 0
    for k, (own, _, t) in enumerate(got):
        n = n + 1 if k and got[k - 1][0] == own else 1
        if n <= per_label:
            out.append((own, t))
    return out


def train(got: list[tuple[str, str]]) -> Crf | None:
    """A model from (language, text) rows; None without any."""
    labels = sorted({own for own, _ in got})
    if not labels:
        return None
    model = Crf(labels)
    order = np.random.default_rng(7).permutation(len(got))
    spliced = []  # beginnings of texts of one language before those of another
    for a, b in zip(order[::4], order[1::4], strict=False):
        (x, t), (y, u) = got[a], got[b]
        if x != y:
            spliced.append(((x, t[:len(t) // 2]), (y, u[len(u) // 2:])))
    learned = []
    for k in range(0, len(order), TEXTS):
        rows = [got[i] for i in order[k:k + TEXTS]]
        block = Block(pa.array([t for _, t in rows], pa.string()))
        learned.append((block, np.repeat([labels.index(x) for x, _ in rows], block.words.count)))
    for k in range(0, len(spliced), TEXTS):
        rows = spliced[k:k + TEXTS]
        own = [Block(pa.array([r[s][1] for r in rows], pa.string())).words.count for s in (0, 1)]
        block = Block(pa.array([f"{a[1]} {b[1]}" for a, b in rows], pa.string()))
        label = np.concatenate([np.repeat([labels.index(a[0]), labels.index(b[0])], [m, n])
                                for (a, b), m, n in zip(rows, *own, strict=True)])
        if len(label) == block.n:
            learned.append((block, label))
    model.list_words(learned)
    model.learn(learned)
    return model


def has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Crf | None, text_col: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``, the mean probability of that language over the
    text's words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    # with many languages fewer texts at once: a row of sums a text
    limit = max(1 << 16, BLOCK_BYTES * 200 // max(200, len(model.labels) if model else 0))
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    out = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in blocks(batches, -1, limit):
            texts = texts_of(batch.column(-1))
            language, score = ["und"] * len(texts), np.zeros(len(texts))
            if crf is not None:
                block = Block(texts)
                w = block.words
                total = np.zeros((len(texts), len(crf.labels)))
                for own, part in block.parts(CELLS // len(crf.labels)):
                    doc = w.doc[own]
                    low = int(doc[0])
                    held = [np.bincount(doc - low, weights=m) for m in crf.marginals(part).T]
                    total[low:low + len(held[0])] += np.stack(held, axis=1)
                best = total.argmax(axis=1)
                score = total[np.arange(len(texts)), best] / np.maximum(w.count, 1)
                plain = np.bincount(w.doc, weights=w.data[w.start] < 128, minlength=len(texts)) if block.n else np.zeros(len(texts))
                for d in range(len(texts)):
                    if w.count[d] and (plain[d] or has_letters(texts[d].as_py())):
                        language[d] = crf.labels[best[d]]
                    else:
                        score[d] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(language, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())],
                                             names=[f.name for f in out.fields])

    small_batches(docs.sparkSession)
    return with_text(docs, kept, text_col).mapInArrow(run, out)


def tag(model: Crf, text: str) -> list[tuple[str, int, int, str, float]]:
    """Each word of a text (lower case) with its place in the lower-cased UTF-8 bytes, its
    language and that language's probability."""
    block = Block(pa.array([text], pa.string()))
    got = model.marginals(block)
    w = block.words
    return [(w.data[a:b].tobytes().decode(), int(a), int(b), model.labels[m.argmax()], float(m.max()))
            for a, b, m in zip(w.start, w.end, got, strict=True)]


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows with a language that are not held out, and predict all rows."""
    out = held_out(id_col, 4, 2)
    model = train(sample(docs.where(~out), lang_col, text_col, PER_LANGUAGE, doc_hash(id_col, text_col)))
    rows = docs.select(F.col(id_col), out.alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).select(id_col, "held_out", "lang_pred", "score")
