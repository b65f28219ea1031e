"""From raw documents to a training mixture: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import decontaminate, language, lines, mixture
from strophe.llm.copies import near_copies
from strophe.llm.ngram_join import SMALL, ngram_join
from strophe.llm.stash import stash
from strophe.session import ship

#: Posterior that the predicted language must have.
SURE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is recognised. Trained on the rows that the language query trains on."""
    ship(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    languages, table = language.train(docs.where(~held))
    names = "_lang_pred" + "_" * len(docs.columns), "_lang_score" + "_" * len(docs.columns)
    told = language.predict(docs, languages, table, names=names)
    return told.where((F.col(names[0]) != "und") & (F.col(names[1]) >= SURE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source, and ``n_chars`` (where there is that column) of what is left; those that
    held nothing else go. Near duplicates among the documents that hold such lines count as one page when the lines are counted again, so
    that copies don't make their own text boilerplate."""
    ship(spark)
    whole, gone = "_whole" + "_" * len(docs.columns), "_gone" + "_" * len(docs.columns)
    bad = lines.boilerplate(docs, "source", "text")
    held = lines.line_dedup(docs.withColumn(whole, F.col("text")), "source", "text", dropped=gone, bad=bad).where(F.col(gone) > 0)
    groups = near_copies(held, "doc_id", whole)
    bad = lines.boilerplate(docs, "source", "text", id="doc_id", groups=groups, among=bad)
    out = lines.line_dedup(docs, "source", "text", bad=bad)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.col("text").rlike(r"\S")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id. Rows without an id stay; rows of equal id and text become one."""
    ship(spark)
    joined = stash(ngram_join(docs), "groups")
    gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    twice = joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone"))
    left = _without(docs, gone)
    if not twice.head(1):
        return left
    return _without(left, twice).unionByName(left.join(twice, F.col("doc_id") == F.col("gone"), "left_semi").dropDuplicates(["doc_id", "text"]))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    few = gone.count() <= SMALL
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("gone"), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each document."""
    return mixture.mixture(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixture", mixture_stage),
]

#: No SQL: language identification and the SimHash search can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
