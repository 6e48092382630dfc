"""A training corpus from documents: quality, language, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of ``docs``.
``run`` writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestgrid.llm.decontaminate import contaminated
from harvestgrid.llm.language_id import identify_languages, row_hash
from harvestgrid.llm.ngram_join import ngram_jaccard_join
from harvestgrid.llm.packing import pack_best_fit
from harvestgrid.llm.quality import classify_quality
from harvestgrid.llm.queries import ship, table
from harvestgrid.llm.tables import cut, plain_name
from harvestgrid.session import new_table_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship(spark)
    return classify_quality(docs, carry=True).where("keep").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; all that have a language train the models."""
    ship(spark)
    judged = identify_languages(docs, F.col("lang").isNotNull())
    gone = judged.where("rejected").select("row_hash").distinct()
    return docs.join(gone, row_hash(docs["doc_id"], docs["text"]) == gone["row_hash"], "left_anti")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their id and text, which is never null, and its name."""
    key = plain_name(docs, "row_key")
    return docs.withColumn(key, row_hash(docs["doc_id"], docs["text"])), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id; null ids come last.

    A document is a row's id and text: different texts under one id, or under none, are judged each for itself. Of rows
    that repeat both, one stays; rows without an id and without a word are alike in nothing and all stay.
    """
    ship(spark)
    keyed, key = _keyed(docs)
    linked = cut(
        ngram_jaccard_join(keyed, id_col=key).where("n_links > 0").select(F.col("doc_id").alias(key), "class_id")
    )
    first = (
        keyed.select(key, "doc_id")
        .distinct()
        .join(linked, key)
        .groupBy("class_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", key)).alias("_first"))
        .select(F.col("_first")[key].alias(key))
    )
    gone = linked.join(first, key, "left_anti").select(key)
    kept = keyed.join(gone, key, "left_anti")
    same = keyed.where(F.col("doc_id").isNotNull() | F.col("text").rlike(r"[\p{L}\p{N}]"))
    repeated = same.groupBy(key).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, key, "left_anti").select(*docs.columns)
    return once.union(kept.join(repeated, key, "left_semi").dropDuplicates([key]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item; each id and text is judged for itself, null ids too."""
    ship(spark)
    keyed, key = _keyed(docs)
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents in packed bins."""
    ship(spark)
    return pack_best_fit(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
# The stages learn, hash and align; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
