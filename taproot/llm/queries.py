"""The corpus operators as registered queries; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.secrets import findings

    return findings(table(spark, sf_dir, "documents"), switches=True)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from taproot.llm.bpe import encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.tiff import digests, stored_texts

    return digests(stored_texts(table(spark, sf_dir, "documents")))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.licences import licensed

    return licensed(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.sharding import hilbert_shards

    return hilbert_shards(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=4)


def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.caps import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Production mixture: the clean domain keeps its tokens, the others shrink to these shares.
MIXTURE = {"clean": 0.9, "junk": 0.08, "toxic": 0.02}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.mixing import labelled_domains, rated

    docs = table(spark, sf_dir, "documents")
    return rated(docs, labelled_domains(table(spark, sf_dir, "labels")), MIXTURE, hold="clean", stretch=True)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from taproot.llm.alignment import alignments

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from taproot.llm.scoring import scored

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return scored(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taproot.llm.negatives import hard_negatives, quantised

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(rows.withColumn("label", moved)), F.col("id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_tiff": op3_tiff,
    "op4_caps": op4_caps,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_licences": op7_licences,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_scoring": op12_scoring,
    "op13_negatives": op13_negatives,
}

#: DuckDB SQL for those queries that SQL can express.
ORACLES: dict[str, str] = {}

ORACLES["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
         array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS b32
  FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""

_REACH = """ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS root FROM ways UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node),
comps AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""

ORACLES["op4_caps"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
{_REACH}
SELECT e.vec_id, CAST(count(w.b) AS BIGINT) AS n_links, coalesce(any_value(c.component), e.vec_id) AS component_id,
       coalesce(any_value(c.component), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN ways w ON w.a = e.vec_id LEFT JOIN comps c ON c.node = e.vec_id GROUP BY e.vec_id
"""

ORACLES["op10_minhash"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
{_REACH}
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN comps ON node = s.doc_id
"""

ORACLES["op13_negatives"] = """
WITH v AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(coalesce(list_dot_product(a.e, b.e), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (
  SELECT anchor, other AS positive, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor, positive, other, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, other AS negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""
