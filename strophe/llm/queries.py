"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines, mixture
from .decontaminate import contamination
from .fingerprint import fingerprints
from .language import language_id
from .lm import lm_scores
from .ngram_join import ngram_join
from .packing import packed_documents
from .quality import importance_sample
from .secrets import secret_scan
from .spelling import spelling_variants
from .tokens import token_counts
from .whiten import whiten


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_docs(spark, sf_dir))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_docs(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_docs(spark, sf_dir))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_docs(spark, sf_dir))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(_docs(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return lines.line_dedup(docs, "source", "text", dropped="n_dropped").select("doc_id", "source", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_docs(spark, sf_dir))


def op9_quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_docs(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_docs(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_docs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_benchmark_decontamination,
        op3_document_fingerprints,
        op4_token_counts,
        op5_lm_scores,
        op6_source_mixture,
        op7_line_dedup,
        op8_language_id,
        op9_quality_sample,
        op10_secret_scan,
        op11_embedding_whitening,
        op12_sequence_packing,
        op13_spelling_variants,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_source_mixture": mixture.SQL, "op7_line_dedup": lines.SQL}
