"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, idcoder, lattice, lexical, licenses, markov, mixing, negatives, quality, secrets, simhash, token_counts
from .common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_groups(table(spark, sf_dir, "documents"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcoder.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.score_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_mixing": op2_mixing,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_embedding_neardup": op5_embedding_neardup,
        "op6_token_binary": op6_token_binary,
        "op7_token_counts": op7_token_counts,
        "op8_simhash_neardup": op8_simhash_neardup,
        "op9_secret_scan": op9_secret_scan,
        "op10_bpe": op10_bpe,
        "op11_lexical_search": op11_lexical_search,
        "op12_lm_score": op12_lm_score,
        "op13_hard_negatives": op13_hard_negatives,
    }


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS n,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
),
k AS (
  SELECT *, -ln(u) / ((CASE WHEN size > 0 AND n::DOUBLE / size BETWEEN 4.0 AND 10.0 THEN 1.0 ELSE 0.5 END)
                      * greatest(0.2, least(1.0, size / 50.0))) AS key FROM d
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
         source_size * 3.0::DOUBLE AS cap FROM s
),
l AS (
  SELECT *, row_number() OVER o AS rank,
         (sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source_size, source NULLS LAST)
),
t AS (
  SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM l WHERE level * w <= cap ORDER BY rank LIMIT 1), 0)) AS target FROM l
),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0 AS mid
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (epochs + CASE WHEN rest > 0 AND mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

_COSINE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
r AS (
  SELECT vec_id, vec_id AS c FROM embeddings
  UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b
),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def _secrets_sql(rules=secrets.RULES, n_base: int = len(secrets.BASE)) -> str:
    parts = []
    for rank, r in enumerate(rules):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least,"
            f" string_split_regex(text, '{regex}') AS p, regexp_extract_all(text, '{regex}', 0) AS h,"
            f" regexp_extract_all(text, '{regex}', {r.group}) AS g FROM d"
        )
    union = "\nUNION ALL ".join(parts)
    counts = ", ".join(f"coalesce(count(*) FILTER (rank = {k}), 0)::BIGINT AS n_{r.kind}" for k, r in enumerate(rules[:n_base]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({union}),
i AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, rank, kind,
         (list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in h[1:i - 1]]), 0))::BIGINT AS b,
         length(h[i]) AS n
  FROM i WHERE length(g[i]) >= least
),
a AS (
  SELECT doc_id, {counts},
         string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) FILTER (rank < {n_base}) AS base,
         string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in rules[:n_base])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


_NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, coalesce(list_inner_product(a.e, b.e), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5
)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b))::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle_sql(),
        "op2_mixing": _MIX_SQL,
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op5_embedding_neardup": _COSINE_SQL,
        "op9_secret_scan": _secrets_sql(),
        "op11_lexical_search": lexical.ORACLE_SQL,
        "op13_hard_negatives": _NEGATIVES_SQL,
    }
