"""The corpus pipeline: five operators one after the other, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.lineage import keep
from heliograph.llm import decontaminate, language_id, packing, surrogates
from heliograph.llm.ngram_join import keep_first_of_groups
from heliograph.llm.queries import pii_key


def _like_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def _free(name: str, docs: DataFrame) -> str:
    """A name for a working column that no column of the documents has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; what has no letter, or too few n-grams of any learned language, goes."""
    model = language_id.train(docs)
    lang_col, score_col = _free("lang_pred", docs), _free("lang_score", docs)
    told = language_id.identify(docs, model, lang_out=lang_col, score_out=score_col).where(F.col(score_col) > 0)
    least = F.lit(0.0)
    for lang, share in language_id.least_shares(docs, model).items():
        least = F.when(F.col(lang_col) == lang, share).otherwise(least)
    return _like_documents(told.where(F.col(lang_col) != language_id.UNKNOWN).where(F.col(score_col) >= least), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, similarity 0.8) the smallest id stays."""
    return _like_documents(keep_first_of_groups(docs, k=5, percent=80), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _like_documents(decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates without collisions; the number of characters follows the text."""
    replaced = surrogates.replace_checked(docs, pii_key(spark), entities_col=_free("entities", docs))
    return _like_documents(replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of training sequences: every piece of every document that is left."""
    return packing.best_fit_pack(docs, packing.word_count(F.col("text")), packing.text_cluster(F.col("text")))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("pii_surrogates", personal_data),
    ("best_fit_packing", packing_plan),
]

#: Language models, keyed surrogates and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"pipeline-{name}")
    return docs
