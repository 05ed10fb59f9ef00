"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.decontaminate import without_benchmark
from tessera.llm.line_dedup import line_dedup
from tessera.llm.pack import pack
from tessera.llm.simhash_dedup import one_of_each
from tessera.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Labels held out (crc32 of the id modulo 4 is 2) are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return not_toxic(docs, labels.select("doc_id", "toxic"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines under windows that an earlier place has; a text may become empty. n_chars follows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup(docs, rest=rest)
    # by place, as names of docs may be those of the operator's own columns
    out = out.toDF(*[f"c{k}" for k in range(len(out.columns))])
    by = {"doc_id": F.col("c0"), "text": F.col("c1")} | {c: F.col(f"c{k + 4}") for k, c in enumerate(rest)}
    if "n_chars" in by:
        by["n_chars"] = F.length("c1").cast("long")
    return out.select(*[by[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack(docs, keep_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Fingerprints, scores, retrieval and tokens can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
