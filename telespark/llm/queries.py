"""Registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.sources.tables import read_table

from . import exact_dedup, hard_negatives, licenses, mixing, near_dedup, packing, pii, quality, secret_scan, sharding, source_audit, substring_dedup, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.fit(docs))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.lookup(read_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    def canonical(text: str) -> str:
        folded = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        plain = f"regexp_replace({folded}, '{licenses.COPYRIGHT_LINE}', chr(10), 'g')"
        form = f"' ' || trim(regexp_replace({plain}, '{licenses.MARKS}', ' ', 'g')) || ' '"
        for a, b in licenses.EQUIVALENT:
            for _ in range(2):
                form = f"replace({form}, ' {a} ', ' {b} ')"
        return f"trim({form})"

    known = ", ".join("({!r}, $${}$$)".format(k, v) for k, v in sorted(licenses.KNOWN.items()))
    return f"""
WITH known(license_id, text) AS (VALUES {known}),
forms AS (SELECT sha256({canonical("text")}) AS canonical_sha256, min(license_id) AS license_id FROM known GROUP BY 1),
docs AS (SELECT doc_id, sha256({canonical("coalesce(text, '')")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM docs LEFT JOIN forms USING (canonical_sha256)"""


ORACLE["op2_license_scan"] = _license_sql()


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read_table(spark, sf_dir, "documents"), mixing.n_tokens() - 1)


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


#: Target shares of tokens.
SOURCE_SHARES = {"src0": 0.2, **{f"src{i}": 0.8 / 19 for i in range(1, 20)}}
LANG_SHARES = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
TOPIC_SHARES = {"prose": 0.85, "notice": 0.05, "contact": 0.06, "table": 0.04}
FRACTION, ROUNDS = 0.6, 12


def margins():
    return {"source": (F.col("source"), SOURCE_SHARES), "lang": (F.col("lang"), LANG_SHARES), "topic": (mixing.topic(), TOPIC_SHARES)}


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), margins(), FRACTION)
    return mixed.select("row.doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def _mixing_sql() -> str:
    names = {"source": ("source", SOURCE_SHARES), "lang": ("lang", LANG_SHARES), "topic": ("topic", TOPIC_SHARES)}

    def named(m: str) -> str:
        return f"CASE WHEN {names[m][0]} IN ({', '.join(repr(k) for k in names[m][1])}) THEN {names[m][0]} ELSE 'other' END AS {m}"

    steps = [rf"""
t AS (SELECT *, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) + 1 AS n_tokens,
    CASE WHEN contains(t, 'icensed under') OR contains(t, 'License.') OR contains(t, 'rights reserved') THEN 'notice'
        WHEN contains(t, '@') OR contains(t, ' +1 ') THEN 'contact' WHEN contains(t, ' | ') THEN 'table' ELSE 'prose' END AS topic FROM t),
d AS (SELECT doc_id, n_tokens, {', '.join(map(named, names))} FROM c),
n AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL),
w AS (SELECT source, lang, topic, n / sum(n) OVER () AS nat FROM n)"""]
    for m, (_, shares) in names.items():
        spec = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in shares.items())
        steps.append(f"""
t_{m} AS (SELECT {m}, CASE WHEN {m} = 'other' THEN share ELSE spec * (1 - sum(CASE WHEN {m} = 'other' THEN share ELSE 0 END) OVER ())
    / sum(CASE WHEN {m} = 'other' THEN 0 ELSE spec END) OVER () END AS target
    FROM (SELECT {m}, sum(nat) AS share, CASE {m} {spec} END::DOUBLE AS spec FROM w GROUP BY {m}))""")
    steps.append("w0 AS (SELECT *, nat AS w FROM w)")
    k = 0
    for _ in range(ROUNDS):
        for m in names:
            steps.append(f"""
w{k + 1} AS (SELECT x.* EXCLUDE (w, target), w * target / sum(w) OVER (PARTITION BY {m}) AS w
    FROM (SELECT w{k}.*, target FROM w{k} JOIN t_{m} USING ({m})) AS x)""")
            k += 1
    return f"""WITH {','.join(steps)},
p AS (SELECT source, lang, topic, round(least(1.0, least({FRACTION}, 1 / max(w / nat) OVER ()) * w / nat), 9) AS probability FROM w{k})
SELECT doc_id, source, lang, topic, n_tokens, probability,
    ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS kept
FROM d JOIN p USING (source, lang, topic)"""


ORACLE["op6_mixing"] = _mixing_sql()


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op7_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)"""


@query
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_rows(read_table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


ORACLE["op8_topk_search"] = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.r <> c.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_duplicates(read_table(spark, sf_dir, "documents"), window=50)


ORACLE["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS b FROM w),
k AS (SELECT doc_id, b, md5(array_to_string(w[b:b + 49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, b + 50)) AS i FROM k JOIN f USING (k) WHERE first < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
    SELECT w.doc_id, w.w, CASE WHEN gone IS NULL THEN w.w ELSE
        list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w.w[i]) END AS kept
    FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(w) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM kept"""


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLE["op10_near_dedup"] = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
        THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id
    JOIN n AS nx ON nx.doc_id = x.doc_id JOIN n AS ny ON ny.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
reach(doc_id, r) AS (
    SELECT a, b FROM link
    UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.r, d.doc_id)) AS component_id,
    d.doc_id <= coalesce(c.r, d.doc_id) AS kept
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) AS c USING (doc_id)"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.usable_rows(read_table(spark, sf_dir, "embeddings"), label, scale=256)
    return hard_negatives.mine(rows, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


ORACLE["op11_hard_negatives"] = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM v AS a JOIN v AS c ON a.vec_id % 50 = 0 AND a.r <> c.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(read_table(spark, sf_dir, "documents"), least_docs=30, terms=50)


ORACLE["op12_source_audit"] = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
f AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
        1 + (1000000000 * (kept.n + 5)) // (v.n + 5 * v.v) AS q, v.v
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p, q FROM f),
pair AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0)::BIGINT AS value
    FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 50"""


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=8)
