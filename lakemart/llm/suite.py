"""The registered queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, len(w[p:p + 9]) AS n, array_to_string(w[p:p + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
dw AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM places CROSS JOIN sizes WHERE p + n - 1 <= len(w)),
hits AS (SELECT dw.r, dw.p, dw.n, bw.item FROM dw JOIN bw USING (gram, n)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
own AS (SELECT r, string_agg(item, ',' ORDER BY item) AS ids, count(*) AS n FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
-- proximity: all words of a window within 15 words, in any order
spots AS (SELECT r, p, w[p] AS t FROM places),
wt AS (SELECT DISTINCT gram, unnest(string_split(gram, ' ')) AS t FROM bw),
often AS (SELECT t, count(*) AS f FROM spots GROUP BY t),
rare AS (SELECT gram, count(*) AS k, arg_min(wt.t, (coalesce(f, 0), wt.t)) AS t FROM wt LEFT JOIN often USING (t) GROUP BY gram),
around AS (
  SELECT DISTINCT rare.gram, rare.k, a.r, b.p, b.t
  FROM rare JOIN spots a USING (t) JOIN spots b ON b.r = a.r AND b.p BETWEEN a.p - 14 AND a.p + 14
  JOIN wt ON wt.gram = rare.gram AND wt.t = b.t),
nexts AS (
  SELECT s.gram, s.k, s.r, s.p, e.t, min(e.p) AS q
  FROM around s JOIN around e ON e.gram = s.gram AND e.r = s.r AND e.p BETWEEN s.p AND s.p + 14
  GROUP BY ALL),
near AS (SELECT gram, r, p, max(q) AS q FROM nexts GROUP BY gram, r, p, k HAVING count(*) = k),
near_words AS (SELECT r, count(DISTINCT x) AS n_near FROM (SELECT r, unnest(range(p, q + 1)) AS x FROM near) GROUP BY r),
near_own AS (
  SELECT r, string_agg(item, ',' ORDER BY item) AS ids, count(*) AS n
  FROM (SELECT DISTINCT r, item FROM near JOIN bw USING (gram)) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(own.n, 0) AS BIGINT) AS n_items, sha256(coalesce(own.ids, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(near_words.n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(near_own.n, 0) AS BIGINT) AS n_near_items,
       sha256(coalesce(near_own.ids, '')) AS near_items_sha256
FROM d LEFT JOIN words USING (r) LEFT JOIN own USING (r) LEFT JOIN near_words USING (r) LEFT JOIN near_own USING (r)
"""


@register("op10_decontamination", OP10_SQL)
def op10(spark, sf_dir):
    from . import decontam
    return decontam.digest(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=decontam.NEAR))


@register("op4_bpe")
def op4(spark, sf_dir):
    import public_tokenizers
    from . import bpe
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False).drop("text")


@register("op1_fingerprints")
def op1(spark, sf_dir):
    from . import iblt
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


@register("op3_language")
def op3(spark, sf_dir):
    from . import langid
    return langid.languages(table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9(spark, sf_dir):
    from . import toxicity
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@register("op7_quality")
def op7(spark, sf_dir):
    from . import quality
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_jaccard_join")
def op5(spark, sf_dir):
    from . import sigtree
    return sigtree.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split(replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(1) || chr(2)), '. ', '. ' || chr(1) || chr(2)),
                                  chr(1) || chr(2)), lambda x: x <> '') AS u
  FROM documents),
l AS (SELECT r, doc_id, i, u[i] AS x, CAST('0x' || substr(md5(u[i]), 1, 8) AS BIGINT) AS h
      FROM (SELECT r, doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM d)),
rolled AS (SELECT *, (h + 31 * lag(h, 1, 0) OVER (PARTITION BY r ORDER BY i)) % 3 = 0 AS c FROM l),
cuts AS (SELECT *, c AND NOT lag(c, 1, false) OVER (PARTITION BY r ORDER BY i) AS e FROM rolled),
own AS (SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cuts),
chunk AS (SELECT r, doc_id, k, min(i) AS s, count(*) AS n, string_agg(x, '' ORDER BY i) AS t FROM own GROUP BY r, doc_id, k),
ranked AS (SELECT *, n >= 2 AND length(t) >= 100 AND dense_rank() OVER (PARTITION BY t, n >= 2 ORDER BY doc_id, s) > 1 AS gone FROM chunk),
kept AS (
  SELECT r, coalesce(sum(CASE WHEN gone THEN n ELSE 0 END), 0) AS n_removed,
         coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS text
  FROM ranked GROUP BY r)
SELECT d.doc_id, CAST(len(d.u) AS BIGINT) AS n_lines, CAST(coalesce(kept.n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept.text, '') AS text
FROM d LEFT JOIN kept USING (r)
"""


@register("op6_line_chunks", OP6_SQL)
def op6(spark, sf_dir):
    from . import linechunks
    return linechunks.remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@register("line_passages")
def line_passages(spark, sf_dir):
    """op6 with short lines and runs of chunks, which its SQL does not state."""
    from . import passages
    return passages.remove(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS path,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS query
  FROM u),
listed(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT r, rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, rule DESC) AS k
  FROM p JOIN listed ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
x AS (
  SELECT p.*, f.rule, f.verdict AS known,
         list_sort(list_distinct(list_transform(regexp_extract_all(host, '[a-z0-9-]+'), lambda t: 'h:' || t)
           || list_transform(list_filter(regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'),
                                         lambda t: regexp_matches(t, '[a-z]')), lambda t: 'p:' || t)
           || list_transform(regexp_extract_all(query, '([a-z0-9_]+)=', 1), lambda t: 'q:' || t))) AS tokens
  FROM p LEFT JOIN fits f ON f.r = p.r AND f.k = 1),
labelled AS (
  SELECT row_number() OVER () AS t, tokens,
         coalesce(known, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 'block' ELSE 'allow' END) AS label
  FROM x JOIN labels ON page_id = doc_id),
least AS (SELECT greatest(3, ceil(0.0005 * count(*))) AS n FROM labelled),
every AS (
  SELECT t, label, array_to_string(list_filter(tokens, lambda k, i: ((m >> (i - 1)) & 1) = 1), ' ') AS ante
  FROM (SELECT t, label, tokens, unnest(range(1, 1 << len(tokens))) AS m FROM labelled)),
total AS (SELECT ante, count(*) AS n FROM every GROUP BY ante),
mined AS (
  SELECT ante, label, support, p AS confidence
  FROM (SELECT every.ante, label, count(*) AS support, any_value(total.n) AS n, count(*) / any_value(total.n) AS p
        FROM every JOIN total USING (ante) GROUP BY every.ante, label)
  WHERE support >= (SELECT n FROM least)
    AND (p + 1.2816 * 1.2816 / 2 / n - 1.2816 * sqrt((p * (1 - p) + 1.2816 * 1.2816 / 4 / n) / n)) / (1 + 1.2816 * 1.2816 / n) >= 0.6),
open AS (SELECT row_number() OVER () AS s, tokens FROM (SELECT DISTINCT tokens FROM x WHERE known IS NULL)),
held AS (
  SELECT s, len(own) AS size, array_to_string(own, ' ') AS ante
  FROM (SELECT s, list_filter(tokens, lambda k, i: ((m >> (i - 1)) & 1) = 1) AS own
        FROM (SELECT s, tokens, unnest(range(1, 1 << len(tokens))) AS m FROM open))),
ranked AS (
  SELECT s, label, confidence, ante AS mined,
         row_number() OVER (PARTITION BY s ORDER BY size DESC, confidence DESC, support DESC, label = 'allow', ante) AS k
  FROM held JOIN mined USING (ante)),
best AS (SELECT open.tokens, label, confidence, mined FROM ranked JOIN open USING (s) WHERE k = 1)
SELECT x.page_id, x.host, x.path, x.rule, coalesce(x.known, best.label, 'allow') AS verdict, best.mined, best.confidence
FROM x LEFT JOIN best ON x.known IS NULL AND best.tokens = x.tokens
"""


@register("op2_url_rules", OP2_SQL)
def op2(spark, sf_dir):
    from . import urlrules
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@register("op8_licenses")
def op8(spark, sf_dir):
    from . import licenses
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, unnest(w) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
total AS (SELECT count(DISTINCT r) AS n, CAST(count(*) AS BIGINT) AS l FROM t),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, total WHERE len(w) > 0),
item AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
query AS (SELECT item_id, term, count(*) AS q FROM item GROUP BY item_id, term),
scored AS (
  SELECT query.item_id, m.r, m.doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m.m))) AS BIGINT) AS score
  FROM query JOIN weight USING (term) JOIN tf USING (term) JOIN m ON m.r = tf.r
  GROUP BY query.item_id, m.r, m.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@register("op11_lexical_search", OP11_SQL)
def op11(spark, sf_dir):
    from . import search
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
gram AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[p:p + 3], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
size AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM gram GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
link AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM common JOIN size p ON p.r = x JOIN size q ON q.r = y
  WHERE 100 * c >= 80 * (p.n + q.n - c) AND p.doc_id <> q.doc_id),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, b AS root FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON reach.root = edge.a),
root AS (SELECT id, least(id, min(root)) AS root FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(root.root, d.doc_id) AS component_id,
       coalesce(coalesce(root.root, d.doc_id) = d.doc_id, true) AS kept
FROM d LEFT JOIN size USING (r) LEFT JOIN root ON root.id = d.doc_id
"""


@register("op12_minhash", OP12_SQL)
def op12(spark, sf_dir):
    from . import minmax
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


@register("op13_token_alignment")
def op13(spark, sf_dir):
    import public_tokenizers
    from . import align
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
