"""Rules of every size and of rare hosts, against brute force."""

import itertools
import math
import random
import time
from collections import Counter

from lakemart.llm import urlrules


def brute(pages, labels):
    def tokens(url):
        host, _, rest = url.split("://")[1].partition("/")
        path, _, query = rest.partition("?")
        return tuple(sorted({*("h:" + x for x in host.split(".")), *("p:" + x for x in path.split("/") if not x.isdigit()),
                             *("q:" + x.split("=")[0] for x in query.split("&") if x)}))

    own = {i: tokens(u) for i, u in pages}
    both, alone = Counter(), Counter()
    for i, good, _ in labels:
        for n in range(1, len(own[i]) + 1):
            for s in itertools.combinations(own[i], n):
                alone[s] += 1
                both[s, "allow" if good else "block"] += 1

    def low(p, n, z=urlrules.Z):
        return (p + z * z / 2 / n - z * math.sqrt((p * (1 - p) + z * z / 4 / n) / n)) / (1 + z * z / n)

    rules = [(s, v, k, k / alone[s]) for (s, v), k in both.items() if k >= urlrules.LEAST and low(k / alone[s], alone[s]) >= urlrules.BOUND]
    out = {}
    for i, t in own.items():
        found = [(-len(s), -c, -k, v == "allow", " ".join(s)) for s, v, k, c in rules if set(s) <= set(t)]
        best = min(found, default=None)
        out[i] = ("allow", None, None) if best is None else ("allow" if best[3] else "block", best[4], round(-best[1], 9))
    return out


def frames(spark, pages, labels):
    return spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    rng = random.Random(9)
    pages, labels = [], []
    for k in range(600):
        host, word, key = rng.choice(["news", "blog", "shop", "wiki"]), rng.choice(["read", "win", "buy"]), rng.choice(["ref", "page", "go"])
        # bad only where all three come together: no pair of them tells
        bad = (host, word, key) == ("shop", "win", "go")
        if k % 120 == 7:  # 5 pages of a rare bad host
            host, word, bad = "evil", "win", True
        pages.append((k, f"http://{host}.example.edu/{word}/{k}?{key}=1"))
        if k % 2 or host == "evil":
            labels.append((k, int(not bad), 0))
    got = {r["page_id"]: (r["verdict"], r["mined"], r["confidence"] and round(r["confidence"], 9)) for r in urlrules.judge(*frames(spark, pages, labels)).collect()}
    assert got == brute(pages, labels)
    three = [k for k, u in pages if "//shop" in u and "/win/" in u and "?go=" in u]
    assert three and all(got[k][0] == "block" and len(got[k][1].split()) >= 3 for k in three)
    evil = [k for k, u in pages if "//evil" in u]
    assert len(evil) == 5 and all(got[k][0] == "block" for k in evil)


def test_copies_of_a_long_url(spark):
    long = "http://copy.example.edu/" + "/".join(f"w{k}x" for k in range(60))
    pages = [(k, long) for k in range(6)] + [(9, long.rsplit("/", 20)[0]), (10, "http://other.edu/")]
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in urlrules.judge(*frames(spark, pages, [(k, 0, 0) for k in range(5)])).collect()}
    assert got[5][0] == "block" and len(got[5][1].split()) == 63 and len(got[9][1].split()) == 43 and got[9][0] == "block"
    assert got[10] == ("block", "h:edu")
    assert all(r["verdict"] == "allow" for r in urlrules.judge(*frames(spark, pages, [(99, 0, 0)])).collect())


def test_long_urls_that_differ_in_one_token(spark):
    long = "http://copy.example.edu/" + "/".join(f"w{k}x" for k in range(40))
    pages = [(k, long) for k in range(5)] + [(5 + k, long + f"/other{k % 2}") for k in range(6)] + [(20, "http://fine.org/a")]
    started = time.time()
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(*frames(spark, pages, [(k, 0, 0) for k in range(9)])).collect()}
    assert all(got[k] == "block" for k in range(11)) and got[20] == "allow"
    assert time.time() - started < 60


def test_support_is_a_share_of_many_labels():
    assert urlrules.least_of(100) == 3 and urlrules.least_of(1_000_000) == 500
