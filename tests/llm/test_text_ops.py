import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lakemart.llm import decontam, licenses, linechunks, sigtree, suite, urlrules
from lakemart.llm.common import Words, blocks, hash_spans
from lakemart.llm.license_texts import TEMPLATES

from .cases import CLASHES, ROWS, documents, empty, prose

SF = "/root/testdata/sf0.001"


def duck(name, spark, sf=SF):
    import duckdb
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = c.execute(suite.ORACLE[name]).fetchdf()
    got = suite.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(suite.ORACLE))
def test_query_against_sql(spark, name):
    duck(name, spark)


def test_words_and_hashes():
    texts = ["", "Ab c", "d" * 100, "é  x", "\n"]
    w = Words(pa.array(texts, pa.string()), sigtree.TOKEN)
    own = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert own == ["ab", "c", "d" * 100, "é", "x"] and w.count.tolist() == [0, 2, 1, 2, 0]
    data = np.frombuffer(b"abcdefghijabcdefghij", np.uint8)
    h = hash_spans(data, np.array([0, 10, 0, 3]), np.array([10, 20, 9, 3]))
    assert h[0] == h[1] != h[2]
    rows = [pa.RecordBatch.from_pydict({"t": ["x" * 10] * 7 + [None]}), pa.RecordBatch.from_pydict({"t": ["y" * 100]})]
    sizes = [b.num_rows for b in blocks(iter(rows), -1, 30)]
    assert sum(sizes) == 9 and len(sizes) >= 3


def brute_hits(text, windows):
    words = decontam.Words(pa.array([text or ""], pa.string()), decontam.WORD).key.tolist()
    inside = set()
    for w in windows:
        for k in range(len(words) - len(w) + 1):
            if words[k:k + len(w)] == w:
                inside |= set(range(k, k + len(w)))
    return len(words), len(inside)


def word_windows(text, window=10):
    k = decontam.Words(pa.array([text or ""], pa.string()), decontam.WORD).key.tolist()
    return [k[j:j + window] for j in range(max(1, len(k) - window + 1) if k else 0)]


def brute_near(text, windows, span):
    """Words in spans that start at a window's word and hold all its words, by a plain loop."""
    words = decontam.Words(pa.array([text or ""], pa.string()), decontam.WORD).key.tolist()
    inside, held = set(), set()
    for item, w in windows:
        need = set(w)
        for s in range(len(words)):
            if words[s] in need:
                seen = set()
                for e in range(s, min(s + span, len(words))):
                    seen.add(words[e])
                    if need <= seen:
                        inside |= set(range(s, e + 1))
                        held.add(item)
                        break
    return len(inside), sorted(map(str, held))


def test_contamination_edge_cases(spark, monkeypatch):
    long = ROWS[6][1]
    items = [(1, " ".join(long.split()[500:512])), (2, None), (3, ""), (4, "one"), (4, "one"), (5, "a B"), (6, prose(99, 30))]
    x = spark.createDataFrame(items, "item_id long, text string")
    keys = {i: decontam.Words(pa.array([t or ""], pa.string()), decontam.WORD).key.tolist() for i, t in items}
    windows = [k[j:j + 10] for k in keys.values() for j in range(max(1, len(k) - 9) if k else 0)]
    found = decontam.contamination(documents(spark), x).collect()
    assert len(found) == len(ROWS)
    want = sorted((str(i), *brute_hits(t, windows)) for i, t, *_ in ROWS)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in found) == want
    assert {r["doc_id"]: r["items"] for r in found}[9] == ["5"] and {r["doc_id"]: r["items"] for r in found}[8] == ["4"]
    monkeypatch.setattr(decontam, "TERM_BITS", 8)  # a full map of terms gives the same
    again = decontam.contamination(documents(spark), x).collect()
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]])
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert all(r["n_hit"] == 0 for r in decontam.contamination(documents(spark), x.where("false")).collect())
    assert decontam.contamination(empty(spark), x).collect() == []


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha x beta y gamma", None, None), (2, "gamma beta alpha", None, None), (3, "alpha beta " + "z " * 30 + "gamma", None, None)])
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.contamination(docs, items, proximity=6).collect()}
    assert got == {1: 5, 2: 3, 3: 0}


@pytest.mark.parametrize("span", [4, 15])
def test_exact_and_near_matches_against_brute_force(spark, span):
    rows = [r for r in ROWS if len(r[1] or "") < 20_000]
    told = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    texts = [" ".join(told[0].split()[9:23][::-1]), " ".join(told[-1].split()[30:38] + ["no", "such"]), "the the of", "one", "A b", None, "",
             " ".join(told[1].split()[3:16]), "one"]
    items = [(k % 8, t) for k, t in enumerate(texts)] + [(None, "b a")]
    windows = [(i, w) for i, t in items for w in word_windows(t)]
    found = decontam.matches(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), proximity=span).collect()
    want = []
    for i, t, *_ in rows:
        n, hit = brute_hits(t, [w for _, w in windows])
        near, held = brute_near(t, [(k, w) for k, w in windows if k is not None], span)
        near = brute_near(t, windows, span)[0]
        want.append((str(i), n, hit, near, held))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_near"], r["near_items"]) for r in found]
    assert sorted(got) == sorted(want)
    assert any(r["n_hit"] for r in found) and (span < 10 or any(r["n_near"] > r["n_hit"] for r in found))
    for r in found:
        for column, n in (("spans", "n_hit"), ("near_spans", "n_near")):
            assert len({k for a, b in r[column] for k in range(a, b)}) == r[n]


def brute_chunks(rows):
    """Texts with repeated chunks removed, by a plain loop."""
    import hashlib
    found = []
    for i, t in rows:
        lines = [x for x in (t or "").replace("\n", "\n\0").replace(". ", ". \0").split("\0") if x]
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        cut = [(a + 31 * b) % linechunks.MODULUS == 0 for a, b in zip(h, [0, *h], strict=False)]
        chunks, own = [], []
        for k, x in enumerate(lines):
            own.append(x)
            if cut[k] and not (k and cut[k - 1]):
                chunks.append(own)
                own = []
        found.append((i, chunks + [own] * bool(own)))
    seen, out = {}, []
    places = sorted((-1 if i is None else i, sum(map(len, c[:k])), "".join(c[k])) for i, c in found for k in range(len(c)) if len(c[k]) > 1)
    for i, s, t in places:
        seen.setdefault(t, (i, s))
    for i, c in found:
        kept = []
        for k in range(len(c)):
            t, at = "".join(c[k]), (-1 if i is None else i, sum(map(len, c[:k])))
            if len(c[k]) < 2 or len(t) < linechunks.MIN_CHARS or seen[t] == at:
                kept.append(t)
        out.append((i, "".join(kept)))
    return sorted(out, key=str)


def test_line_chunks_against_brute_force(spark):
    rows = [(i, t) for i, t, *_ in ROWS]
    shared = prose(77, 160, 8)
    rows += [(200 + k, prose(k + 300, 25) + ".\n" + shared + "\n" + prose(k + 500, 25)) for k in range(6)]
    x = documents(spark, [(i, t, None, None) for i, t in rows])
    out = linechunks.remove(x)
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute_chunks(rows)
    assert set(CLASHES) <= set(out.columns) and all(r[c] == k for r in got for k, c in enumerate(CLASHES))
    # the passage goes from all documents but the first, though other lines stand before it
    lost = [len(t) - len(next(r["text"] for r in got if r["doc_id"] == i)) for i, t in rows if i and i >= 200]
    assert lost[0] == 0 and min(lost[1:]) > len(shared) / 2
    assert linechunks.remove(empty(spark)).collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_url_rules_edge_cases(spark):
    pages = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.NET/en/x"), (5, "http://net"), (6, "http://net/"), (7, "x://example.com/de/1?q=1"),
             (8, "http://www.example.org/fr/"), (9, "http://notnet/"), (9, "http://notnet/"), (10, "http://a.net?x=://b"), (11, "http://a.net#/y")]
    x = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1, 0), (9, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = urlrules.judge(x, labels).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert by == {1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("a.example.net", "/en/x", "example.net/en/"), 5: ("net", "", None),
                  6: ("net", "/", "net/"), 7: ("example.com", "/de/1", "example.com/de/"), 8: ("www.example.org", "/fr/", "org/fr/"),
                  9: ("notnet", "/", None), 10: ("a.net", "", None), 11: ("a.net", "", None)}
    assert {r["verdict"] for r in got} <= {"allow", "block"} and all(r["verdict"] == "allow" for r in got if r["page_id"] in (1, 2, 3))
    assert urlrules.judge(x.where("false"), labels).collect() == []
    assert len(urlrules.judge(x, labels.where("false")).collect()) == len(pages)


def test_mined_rules_decide(spark):
    rng = random.Random(3)
    pages, labels = [], []
    for k in range(400):
        bad = rng.random() < 0.4
        host = rng.choice(["casino", "bets"]) if bad else rng.choice(["news", "blog"])
        pages.append((k, f"http://{host}.example.org/{'win' if bad else 'read'}/{k}"))
        labels.append((k, int(not bad), 0))
    got = urlrules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")).collect()
    assert all((r["verdict"] == "block") == (labels[r["page_id"]][1] == 0) for r in got)
    assert all(r["mined"] and r["confidence"] >= urlrules.BOUND for r in got)


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(60):
        v = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        got = [v[k] for k in licenses.increasing(v)]
        assert all(a < b for a, b in itertools.pairwise(got))
        best = max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if all(a < b for a, b in itertools.pairwise(c))), default=0)
        assert len(got) == best


def test_alignment():
    t = "a b c d e f g".split()
    assert licenses.align(t, t) == [(k, k) for k in range(7)]
    assert licenses.align("x a b q c d z".split(), "a b c d".split()) == [(1, 0), (2, 1), (4, 2), (5, 3)]
    assert licenses.align([], t) == licenses.align(t, []) == []
    assert len(licenses.align("the the a the the".split(), "the the a the the".split())) == 5  # gaps without unique words


def test_licenses(spark):
    mit, gpl = TEMPLATES["MIT-text"], TEMPLATES["GPL-3.0"]
    edited = " ".join(w for k, w in enumerate(mit.split()) if k % 15)
    rows = [(1, prose(1, 50) + "\n" + mit + "\n" + prose(2, 50)), (2, edited), (3, gpl + "\n" + prose(1, 9) + "\n" + gpl), (4, None), (5, ""),
            (6, prose(4, 5000)), (7, "license version software permission copies"), (8, "é " + TEMPLATES["Apache-2.0"])]
    x = licenses.scan(documents(spark, [(i, t, None, None) for i, t in rows]))
    got = {r["doc_id"]: r["found"] for r in x.collect()}
    text = dict(rows)
    assert [m["license"] for m in got[1]] == ["MIT-text"] and got[1][0]["coverage"] == 1
    assert text[1][got[1][0]["start"]:got[1][0]["end"]] == mit.rstrip(".")
    assert [m["license"] for m in got[2]] == ["MIT-text"] and 0.85 < got[2][0]["coverage"] < 1
    assert [m["license"] for m in got[3]] == ["GPL-3.0"] * 2
    assert [m["license"] for m in got[8]] == ["Apache-2.0"] and got[8][0]["start"] == 2
    assert all(got[k] == [] for k in (4, 5, 6, 7))
    assert licenses.scan(empty(spark)).collect() == []
    assert all(r["found"] == [] for r in licenses.scan(documents(spark), {}).collect())


def test_pipeline_stages(spark):
    """Each stage against a plain computation over what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    from lakemart.llm import quality
    from lakemart.llm.common import staged
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test")
        held[name] = (docs.collect(), out.collect())
        if name != "encoding":
            assert out.columns == docs.columns
        docs = out
    before, after = held["quality"]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score, _ = model.score(quality.Passages(pa.array([r["text"] or "" for r in before], pa.string())))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, s in zip(before, score, strict=True) if s >= 0.5}
    before, after = held["line_dedup"]
    assert sorted(((r["doc_id"], r["text"]) for r in after), key=str) == brute_chunks([(r["doc_id"], r["text"]) for r in before])
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = held["near_duplicates"]
    from .test_join import brute
    want = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in before], 5, 80, 100) if i == c}
    assert {r["doc_id"] for r in after} == want
    before, after = held["decontamination"]
    windows = [windowed for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for windowed in word_windows(r["text"])]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not brute_hits(r["text"], windows)[1]}
    before, after = held["encoding"]
    assert {r["doc_id"]: r["n_tokens"] for r in after}.keys() == {r["doc_id"] for r in before}
    assert all(len(r["ids"]) == r["n_tokens"] for r in after)


def test_every_operator_is_registered():
    q = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and corpus_pipeline.ORACLE_SQL is None
