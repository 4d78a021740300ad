"""The operators' queries over whole tables, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where the public tokenizers' files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simple8b

    return simple8b.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .common import remainder

    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.groups(table(spark, sf_dir, "documents"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints

    return fingerprints.compare(table(spark, sf_dir, "documents"))


@query
def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.held_out_scores(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.linked(table(spark, sf_dir, "documents"))


@query
def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kmeans

    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


@query
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import search

    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words as the contract has them, for DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE["op4_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[k : k + 9] AS win FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
hit AS (SELECT x.doc_id, x.k, x.n, win.item_id FROM (SELECT doc_id, k, n, w[k : k + n - 1] AS win FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)) x JOIN win USING (win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
ORACLE["op8_near_dedup"] = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
grams AS (SELECT rn, array_to_string(w[k : k + 4], ' ') AS g, count(*) AS n FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k) WHERE len(w) > 0 GROUP BY ALL),
sizes AS (SELECT rn, sum(n) AS m FROM grams GROUP BY rn),
pairs AS (SELECT a.rn AS x, b.rn AS y, sum(least(a.n, b.n)) AS same FROM grams a JOIN grams b ON a.g = b.g AND a.rn < b.rn GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes a ON a.rn = x JOIN sizes b ON b.rn = y WHERE same >= 0.8 * (a.m + b.m - same) - 1e-9
  UNION SELECT a.rn, b.rn FROM d a JOIN d b ON a.t = b.t AND a.rn < b.rn WHERE len(a.w) = 0 AND len(b.w) = 0),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT rn, rn AS other FROM d UNION SELECT r.rn, b.y FROM reach r JOIN ways b ON b.x = r.other),
own AS (SELECT rn, min(other) AS root FROM reach GROUP BY rn)
SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS class_size FROM d JOIN own USING (rn) WINDOW w AS (PARTITION BY root)
"""
ORACLE["op10_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(0, len(x) // 2 - 49)) AS k)),
earliest AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM win JOIN earliest USING (s) WHERE f < doc_id),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone) GROUP BY doc_id, run),
lost AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN lost USING (doc_id)
"""
ORACLE["op11_ngram_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT rn, array_to_string(w[k : k + 3], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k) WHERE len(w) > 0),
sizes AS (SELECT rn, count(*) AS n FROM grams GROUP BY rn),
pairs AS (SELECT a.rn AS x, b.rn AS y, count(*) AS same FROM grams a JOIN grams b ON a.g = b.g AND a.rn < b.rn GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes a ON a.rn = x JOIN sizes b ON b.rn = y WHERE 100 * same >= 85 * (a.n + b.n - same)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT rn, rn AS other FROM d UNION SELECT r.rn, b.y FROM reach r JOIN ways b ON b.x = r.other),
own AS (SELECT rn, min(other) AS root FROM reach GROUP BY rn)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(doc_id) OVER (PARTITION BY root) AS component_id FROM d JOIN own USING (rn) LEFT JOIN sizes USING (rn)
"""
ORACLE["op12_kmeans"] = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cent AS (SELECT 0 AS r, k, e AS c FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS k, e FROM v) WHERE k < 8
  UNION ALL
  SELECT o.r + 1, o.k, coalesce(s.c, o.c) FROM cent o LEFT JOIN (SELECT k, list(m ORDER BY p) AS c FROM (SELECT k, p, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS p FROM (SELECT v.rn, v.e, arg_min(c.k, list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 8 + c.k) AS k FROM v, cent c GROUP BY v.rn, v.e)) GROUP BY k, p) GROUP BY k) s ON s.k = o.k WHERE o.r < 10),
last AS (SELECT k, c FROM cent WHERE r = 10),
near AS (SELECT rn, vec_id, arg_min(k, d * 8 + k) AS k, min(d) AS d FROM (SELECT v.rn, v.vec_id, l.k, list_sum(list_transform(list_zip(v.e, l.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, last l) GROUP BY rn, vec_id)
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM near JOIN last USING (k)
"""
ORACLE["op13_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {WORDS} AS w FROM documents),
sums AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
post AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, sums GROUP BY term),
asked AS (SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest({WORDS}) AS term FROM benchmark)),
scored AS (SELECT item, item_id, rn, doc_id, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n) // l))))::BIGINT AS score FROM asked JOIN weight USING (term) JOIN post USING (term) JOIN d USING (rn), sums GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
