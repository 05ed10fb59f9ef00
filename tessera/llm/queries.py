"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import benchmark_matches
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.line_dedup import line_dedup
from tessera.llm.pack import pack
from tessera.llm.quality import quality_scores
from tessera.llm.shard import shuffle_shards
from tessera.llm.simhash_dedup import simhash_dedup
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.toxicity import toxicity_scores
from tessera.llm.url_filter import url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def _remainder(of: int):
    """crc32 of doc_id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(_remainder(3) != 1).select("doc_id", "quality")
    out = quality_scores(_read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), keep_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(_remainder(4) != 2).select("doc_id", "toxic")
    out = toxicity_scores(_read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_shards(_read(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of its number: block if toxic or of low quality, else allow."""
    pages, labels = _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")
    verdict = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow")
    labelled = pages.join(labels.where("quality is not null and toxic is not null"), pages["page_id"] == labels["doc_id"]).select("url", verdict.alias("verdict"))
    return url_filter(pages, labelled)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_url_filter": op10_url_filter,
}

SQL = {
    "op2_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""",
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, words, unnest(range(0, len(words) - 12)) AS s FROM w WHERE len(words) >= 13),
k AS (SELECT doc_id, s, array_to_string(words[s + 1 : s + 13], ' ') AS run FROM t),
f AS (SELECT run, min(doc_id) AS first_doc FROM k GROUP BY run),
g AS (SELECT DISTINCT k.doc_id, k.s + unnest(range(0, 13)) AS p FROM k JOIN f USING (run) WHERE f.first_doc < k.doc_id),
c AS (SELECT doc_id, count(*) AS n, list(p) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda i : NOT list_contains(gone, i - 1))) END, ' ')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
""",
    "op6_line_dedup": """
WITH w AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS s FROM w WHERE len(lines) >= 3),
k AS (SELECT doc_id, s, array_to_string(lines[s + 1 : s + 3], chr(10)) AS run FROM t),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, s + unnest(range(0, 3)) AS p FROM r WHERE nth > 1),
c AS (SELECT doc_id, count(*) AS n, list(p) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN lines ELSE list_select(lines, list_filter(range(1, len(lines) + 1), lambda i : NOT list_contains(gone, i - 1))) END, chr(10))) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
""",
}
