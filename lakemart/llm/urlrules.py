"""URL verdicts by listed rules and mined association rules (DataFrame functions and Spark's
FP-growth only).

A URL's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; its path what follows up to ``?``, ``#`` or the end.  A listed rule ``host/path``
fits its host and all subdomains where the URL's path starts with the rule's; the longest
fitting rule decides.

For all other URLs rules are mined.  A URL's tokens are the labels of its host, the words of
its path that hold a letter, and the keys of its query.  Labelled URLs (a listed rule's
verdict, else a bad label of the page: block; a good one: allow) are mined by FP-growth for
token sets of every size.  A set is a rule for a verdict where at least ``least_of`` labelled URLs
(``LEAST``, and ``SHARE`` of all) hold it with the verdict and the lower end of the confidence's
Wilson interval (``Z``) is at least ``BOUND``, which guards small counts.  Tokens that the same
labelled token sets hold count as one item: a set's support and confidence hang on the items
alone, so nothing is lost, and copies of a long URL give one set, not one for each choice of its
tokens.  ``SHARE`` bounds what the miner gathers on the driver: at most tokens a URL / ``SHARE``
frequent items, whatever the number of pages.

Rules are matched through an inverted index: each is listed under its rarest item, looked up by
the items of the distinct token sets, and checked for its others.  Of the matching rules the one
with most tokens decides, then confidence, support, block before allow, and tokens in order;
without any the verdict is allow.

Defined results: a null URL, or one without ``://``, has empty host and path, no tokens, and
is allowed; labels of unknown pages are not used, several labels of a page each count; repeated
rows are each judged; an empty table gives none, and without labels nothing is mined; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LEAST, SHARE, BOUND, Z = 3, 0.0005, 0.6, 1.2816


def lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> dict[str, Column]:
    """host, path and query of a URL, each empty where it has none."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    return {"host": lower(F.regexp_extract(after, pattern, 1)), "path": F.regexp_extract(after, pattern, 2),
            "query": F.regexp_extract(after, pattern, 3)}


def listed(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule and its verdict, as a struct (null: none fits)."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """Sorted distinct tokens of host, path and query."""
    host = F.transform(F.regexp_extract_all("host", F.lit("([a-z0-9-]+)"), 1), lambda x: F.concat(F.lit("h:"), x))
    words = F.filter(F.regexp_extract_all(lower(F.col("path")), F.lit("([a-z0-9]+)"), 1), lambda x: x.rlike("[a-z]"))
    path = F.transform(words, lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(lower(F.col("query")), F.lit("([a-z0-9_]+)="), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_sort(F.array_distinct(F.concat(host, path, keys)))


def match_best(found: DataFrame) -> DataFrame:
    """Of the rules found for each ``tokens`` array the one that decides."""
    rank = F.struct((-F.size("ante")).alias("size"), (-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"),
                    (F.col("verdict") == "allow").alias("allow"), F.array_join("ante", " ").alias("mined"))
    best = found.groupBy("tokens").agg(F.min(rank).alias("r"))
    return best.select("tokens", F.col("r.mined").alias("mined"), F.when(F.col("r.allow"), "allow").otherwise("block").alias("verdict"),
                       (-F.col("r.c")).alias("confidence"))


def token_items(labelled: DataFrame) -> DataFrame:
    """Each token of the labelled URLs and its ``item``: tokens of the same token sets share one."""
    own = labelled.select("tokens").distinct().select(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(7), "tokens").alias("b"), F.explode("tokens").alias("token"))
    same = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    return same.select("token", F.concat_ws(".", "n", F.hex("a"), F.hex("b")).alias("item"))


def least_of(labelled: int) -> int:
    """Labelled URLs that must hold a rule's set with its verdict."""
    return max(LEAST, math.ceil(SHARE * labelled))


def mine(labelled: DataFrame, items: DataFrame, bound: float = BOUND) -> DataFrame:
    """Rules of every size (``ante`` array of items, ``verdict``, ``support`` count, ``confidence``,
    ``anchor``) from rows of ``tokens`` and ``label``."""
    sets = labelled.select("tokens").distinct()
    named = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token") \
        .groupBy("tokens").agg(F.collect_set("item").alias("own"))
    held = staged(labelled.join(named, "tokens").select(F.array_append("own", F.concat(F.lit("="), F.col("label"))).alias("items")), "url-items")
    n = max(held.count(), 1)
    # half a URL less: the miner rounds support x count up, to the number itself
    sets = FPGrowth(itemsCol="items", minSupport=min((least_of(n) - 0.5) / n, 1.0), minConfidence=bound).fit(held).freqItemsets
    sets = staged(sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("ante"),
                              F.filter("items", lambda x: x.startswith("=")).alias("label"), "freq")
                  .where((F.size("ante") >= 1) & (F.size("label") <= 1)), "url-sets")
    alone = sets.where(F.size("label") == 0).select("ante", F.col("freq").cast("double").alias("all"))
    p, z2 = F.col("freq") / F.col("all"), Z * Z
    low = (p + z2 / 2 / F.col("all") - Z * F.sqrt((p * (1 - p) + z2 / 4 / F.col("all")) / F.col("all"))) / (1 + z2 / F.col("all"))
    good = sets.where(F.size("label") == 1).join(alone, "ante").withColumn("confidence", p).where(low >= bound)
    # the rarest item: an item's name begins with the number of token sets that hold it
    anchor = F.array_min(F.transform("ante", lambda x: F.struct(F.substring_index(x, ".", 1).cast("long").alias("n"), x.alias("item"))))["item"]
    return good.select("ante", F.substring(F.col("label")[0], 2, 20).alias("verdict"), F.col("freq").alias("support"), "confidence", anchor.alias("anchor"))


def match(sets: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``tokens`` array the rule that decides: ``mined`` (its tokens, joined by spaces), ``verdict`` and
    ``confidence``.  A rule's tokens in a URL are all that the URL has of its items."""
    own = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token") \
        .groupBy("tokens").agg(F.collect_list(F.struct("item", "token")).alias("own"))
    own = own.withColumn("held", F.array_distinct(F.transform("own", lambda x: x["item"])))
    found = own.withColumn("anchor", F.explode("held")).join(rules, "anchor").where(F.size(F.array_except("ante", "held")) == 0)
    ante = F.array_sort(F.transform(F.filter("own", lambda x: F.array_contains(F.col("ante"), x["item"])), lambda x: x["token"]))
    return match_best(found.select("tokens", ante.alias("ante"), "verdict", "support", "confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
          label_id: str = "doc_id") -> DataFrame:
    """Every page's host, path, listed ``rule``, ``verdict``, and where no rule is listed the
    ``mined`` one and its ``confidence``."""
    x = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    x = x.select("id", *[F.coalesce(v, F.lit("")).alias(k) for k, v in parts(F.col("url")).items()])
    x = x.select("id", "host", "path", listed(rules).alias("l"), tokens().alias("tokens"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.select(F.col(label_id).alias("id"), F.when(bad, "block").otherwise("allow").alias("label"))
    labelled = x.join(known, "id").select("tokens", F.coalesce("l.verdict", "label").alias("label"))
    # written: the join with the pages then has a side of its own, which is broadcast or, by size, split where it is skewed
    open_sets = x.where("l is null").select("tokens").distinct()
    labelled = staged(labelled, "url-labelled")
    items = staged(token_items(labelled), "url-token-items")
    found = match(open_sets, items, mine(labelled, items))
    found = staged(found, "url-verdicts")
    open_ = x.where("l is null").join(found, "tokens", "left").select(
        "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"), "mined", "confidence")
    closed = x.where("l is not null").select("id", "host", "path", "l.rule", "l.verdict", F.lit(None).cast("string").alias("mined"),
                                             F.lit(None).cast("double").alias("confidence"))
    return closed.unionByName(open_).withColumnRenamed("id", id_col)
