import hashlib

import numpy as np

from lakemart.llm import iblt

from .cases import ROWS, documents, empty, prose


def test_difference_is_the_set_difference():
    a = iblt.Paragraphs([prose(1, 300), prose(2, 4000), "", "same"])
    b = iblt.Paragraphs([prose(1, 300) + " more words here", prose(3, 3000), "now", "same"])
    at = np.arange(4)
    digest, pair, sign = iblt.differences(a, iblt.sketch(a), b, iblt.sketch(b), at, at)
    for k in range(4):
        x, y = set(a.of(np.array([k]))[0].tolist()), set(b.of(np.array([k]))[0].tolist())
        assert set(digest[(pair == k) & (sign > 0)].tolist()) == x - y
        assert set(digest[(pair == k) & (sign < 0)].tolist()) == y - x
    assert (pair == 1).sum() > iblt.CELLS * 4  # far beyond the fingerprint: larger sketches were tried


def test_fingerprint_text_round_trip():
    p = iblt.Paragraphs([prose(1, 200), "", prose(2, 50)])
    s = iblt.sketch(p)
    t = iblt.from_text(s.text())
    assert (t.n == s.n).all() and (t.x == s.x).all() and (t.c == s.c).all()
    assert set(iblt.sketch(iblt.Paragraphs([""])).text()[0]) <= set("A=")


def test_query_against_brute_force(spark):
    got = {}
    for r in iblt.fingerprints(documents(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    rows = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        want = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        assert hashlib.sha256(want.encode()).hexdigest() in {r["edited_sha256"] for r in got[i]}
        assert {r["n_chars"] for r in got[i]} == {len(t)}
        for r in got[i]:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert r["near_edited"] == 1 if want == t else r["near_edited"] < 1
    assert got[1][0]["fingerprint"] == got[5][0]["fingerprint"] != got[6][0]["fingerprint"]
    assert 0.3 < got[7][0]["near_edited"] < 0.7
    assert iblt.fingerprints(empty(spark)).collect() == []
    one = iblt.fingerprints(documents(spark, ROWS[:1])).collect()  # follows itself
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_many_partitions(spark):
    """As many ranges as a large cluster has partitions: the plan doesn't grow with them."""
    rows = [(k, f"text {k} of a row", None, None) for k in range(3000)] + [(None, "no id", None, None)]
    x = documents(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted((tuple(r)[:4] for r in iblt.fingerprints(x).select("doc_id", "n_chars", "edited_sha256", "near_next").collect()), key=str)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        many = iblt.fingerprints(x).select("doc_id", "n_chars", "edited_sha256", "near_next")
        assert len(many._jdf.queryExecution().optimizedPlan().toString()) < 20000
        got = sorted((tuple(r) for r in many.coalesce(8).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
