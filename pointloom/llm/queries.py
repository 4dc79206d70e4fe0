"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, dualtree, fingerprint, hardneg, html, media, neardup, packing, quality, substrings, tokens, urls, warc


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(common.table(spark, sf_dir, "documents"))


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), vocabulary())


def op3_imatch_lexicon_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(common.table(spark, sf_dir, "documents"))


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), vocabulary())


def op5_warc_segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


#: The rules of the contract (host, path prefix, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(common.table(spark, sf_dir, "pages"), rules)


def op7_two_pass_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.table(spark, sf_dir, "pages"))


def op9_latent_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_icws_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(common.table(spark, sf_dir, "documents")).drop("th")


def op8_blockwise_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(common.table(spark, sf_dir, "documents"))


def op11_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.clusters(common.table(spark, sf_dir, "embeddings"))


def op12_patched_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(common.table(spark, sf_dir, "embeddings"))


QUERIES = (op1_interleaved_media, op2_cost_balanced_packing, op3_imatch_lexicon_subsets, op4_pair_index_bpe, op5_warc_segment_reassembly, op6_blocked_bloom_urls, op7_two_pass_blocks, op8_blockwise_repeats, op9_latent_neighbour_vote, op10_icws_near_duplicates, op11_dual_tree_clusters, op12_patched_token_files, op13_pivot_hard_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1), '' ORDER BY k) AS b32
      FROM (SELECT DISTINCT h FROM p), range(32) t(k) GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, true AS complete
FROM f JOIN d USING (h)
"""

URL_SQL = f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.*, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(r.host) + length(r.path) DESC NULLS LAST, length(r.host) DESC) AS k
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def _lloyd_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds as a chain of tables: components as rows, squared distances as sums."""
    kept = f"""v AS MATERIALIZED (SELECT vec_id, [floor(256*x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
x AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range({dims})) AS d FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h)-1 AS c, unnest(v) AS x, unnest(range({dims})) AS d FROM (SELECT v, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))"""
    steps = [kept]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, c, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, c) AS rn FROM (SELECT x.vec_id, c.c, sum((x.x-c.x)*(x.x-c.x))::BIGINT AS s FROM x JOIN c{n} c USING (d) GROUP BY 1, 2)) WHERE rn = 1)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT a.c, x.d, sum(x.x)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} a USING (vec_id) GROUP BY 1, 2)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.d, CASE WHEN n IS NULL THEN o.x ELSE (s-((s%n)+n)%n)//n END AS x FROM c{n} o LEFT JOIN m{n} m ON m.c = o.c AND m.d = o.d)")
    names = f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)"
    return f"WITH {', '.join([*steps, names])} SELECT vec_id, c::INT AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h USING (c)"


LLOYD_SQL = _lloyd_sql()


NEGATIVES_SQL = """
WITH e AS MATERIALIZED (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, [floor(256*x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id, b.label, list_sum([a.v[k] * b.v[k] FOR k IN range(1, least(len(a.v), len(b.v)) + 1)])::BIGINT AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE label = al) WHERE rn <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE s.label <> s.al AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_segment_reassembly": WARC_SQL, "op6_blocked_bloom_urls": URL_SQL, "op11_dual_tree_clusters": LLOYD_SQL, "op13_pivot_hard_negatives": NEGATIVES_SQL}
