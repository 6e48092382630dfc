"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import harvestgrid
from harvestgrid.llm.decontaminate import contaminated
from harvestgrid.llm.embedding_join import embedding_near_duplicates
from harvestgrid.llm.html_text import extract_main_text
from harvestgrid.llm.importance import importance_resample
from harvestgrid.llm.language_id import identify_languages
from harvestgrid.llm.ngram_join import ngram_jaccard_join
from harvestgrid.llm.oracle import SQL as SQL
from harvestgrid.llm.packing import pack_best_fit
from harvestgrid.llm.quality import classify_quality
from harvestgrid.llm.sharding import shard_documents
from harvestgrid.llm.source_divergence import source_divergence
from harvestgrid.llm.token_packs import pack_token_ids
from harvestgrid.llm.toxicity import learn_lexicon, score_toxicity
from harvestgrid.llm.url_filter import url_verdicts

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(harvestgrid.__file__)
    archive = os.path.join(tempfile.mkdtemp(prefix="harvestgrid-code-"), "harvestgrid_code.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_token_ids(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    return identify_languages(table(spark, sf_dir, "documents"), trains).select(
        F.col("id").alias("doc_id"), (~F.col("trains")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_packs,
        op2_decontamination,
        op3_url_filter,
        op4_language_id,
        op5_html_extraction,
        op6_best_fit_packing,
        op7_quality,
        op8_sharding,
        op9_ngram_join,
        op10_embedding_join,
        op11_source_divergence,
        op12_importance_resampling,
        op13_toxicity,
    )
}
