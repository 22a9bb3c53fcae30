"""From raw documents to packed training sequences, one stored table a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import languages, mixing, neardup, packing, quality
from threadloom.llm.shared import columns_of, stored, unused

#: Least score of a language that a document needs to stay; texts that mix languages are above.
MIN_LANGUAGE_SCORE = 0.05

#: Stages 1, 3 and 5 are iterative or learned, so no SQL stands for the whole; tests hold them against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter and those that no language labels well.

    Where no language can be learned (no row has one), texts with a letter stay. Rows and columns are unchanged.
    """
    model = languages.learn(docs.filter(~languages.held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    label = unused(docs, "label")
    rows = docs.withColumn(label, languages.identify(docs, model, F.col("text")))
    return rows.filter((F.col(label)["lang"] != languages.UND) & (F.col(label)["score"] >= MIN_LANGUAGE_SCORE)).select(*columns_of(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule; null and empty texts do. Rows and columns are unchanged; an empty table gives none."""
    prefix = unused(docs, "q") + "_"
    return quality.with_quality(docs, prefix=f"__{prefix}").filter(f"`__{prefix}kept`").select(*columns_of(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows with a null id all stay, those without words once for each id; an empty table gives none.
    """
    return neardup.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut where the budget ends; n_chars follows the text.

    Null and empty texts are in no mix; an empty table gives none.
    """
    mix = mixing.mixed_documents(docs)
    return mix.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else mix


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens, and their tokens.

    Null and empty texts are the closing id alone; an empty table gives no rows.
    """
    return packing.packed(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
