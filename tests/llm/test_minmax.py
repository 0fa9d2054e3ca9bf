import random

import numpy as np
import pyarrow as pa

from lakemart.llm import minmax
from lakemart.llm.sigtree import Sets

from .cases import ROWS, documents, empty, prose
from .test_join import brute, got


def edited(rng, count):
    """Texts and edits of them around the threshold, in chains."""
    base = [prose(k, rng.choice([4, 12, 60, 200])).split() for k in range(6)]
    rows = []
    for k in range(count):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 40)}"
        rows.append((100 + k, " ".join(w)))
        if rng.random() < 0.3:
            base.append(w)
    return rows


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in ROWS if len(t or "") < 20000] + edited(random.Random(8), 120)
    rows.append((11, prose(44, 30)))  # an id with two texts
    x = documents(spark, [(i, t, None, None) for i, t in rows])
    want = brute(rows, 4, 80, 100)
    for limit in (minmax.BUCKET_BYTES, 4000):  # with buckets cut into blocks, too
        monkeypatch.setattr(minmax, "BUCKET_BYTES", limit)
        out = minmax.near_duplicates(x).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in out)


def test_a_hot_bucket_of_copies_and_near_copies(spark):
    """A third of the rows are copies, another third near copies of one text, beside texts that share a passage with it."""
    text = prose(5, 80).split()
    rows = [(k, " ".join(text)) for k in range(60)]
    rows += [(100 + k, " ".join([*text[:70], f"x{k}", *text[71:]])) for k in range(60)]
    rows += [(200 + k, " ".join(text[:55]) + " " + prose(600 + k, 30)) for k in range(20)]
    x = documents(spark, [(i, t, None, None) for i, t in rows])
    assert got(minmax.near_duplicates(x)) == brute(rows, 4, 80, 100)


def test_empty_tables(spark):
    assert minmax.near_duplicates(empty(spark)).collect() == []
    rows = [tuple(r) for r in minmax.near_duplicates(documents(spark, [(1, None, None, None), (2, "", None, None), (3, " ", None, None)])).collect()]
    assert sorted(rows) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_signatures_are_unbiased_and_vary_less():
    """Minima and maxima agree as often as the sets' similarity says, with half the hash functions."""
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(150):
        size, common = 60, int(rng.integers(10, 60))
        pool = rng.integers(0, 1 << 63, 2 * size).astype(np.uint64)
        both = [np.sort(pool[:size]), np.sort(np.concatenate([pool[:common], pool[size:2 * size - common]]))]
        s = Sets(pa.array(["", ""]), 4)
        s.key, s.size, s.first, s.docs = np.concatenate(both), np.array([size, size]), np.array([0, size]), 2
        v = minmax.signature(s)
        errors.append((v[0] == v[1]).mean() - common / (2 * size - common))
        assert v.shape == (2, 2 * minmax.PERMUTATIONS)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.25 / (2 * minmax.PERMUTATIONS)  # as many independent values would vary at most


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 110).astype(np.uint64)
        one, two = np.sort(pool[:90]), np.sort(np.concatenate([pool[:80], pool[100:110]]))
        s = Sets(pa.array(["", ""]), 4)
        s.key, s.size, s.first, s.docs = np.concatenate([one, two]), np.array([90, 90]), np.array([0, 90]), 2
        key = minmax.bands(minmax.signature(s))
        missed += not (key[0] == key[1]).any()
    assert missed == 0
