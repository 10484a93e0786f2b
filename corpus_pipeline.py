"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.

Defined cases: every stage handles nulls, empty texts, repeated rows and empty
tables as its operator does; extra columns of ``docs`` are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, packing, quality, secrets
from millrace.llm._tables import discarded, written
from millrace.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is at least 0.7 stay."""
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (word 5-grams, 0.8) the document with the smallest id stays."""
    ship_package(spark)
    return jaccard.deduplicated(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return decontaminate.clean(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars follows."""
    docs = docs.select(*COLUMNS)
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark, docs)), keep=list(COLUMNS))
    spans = F.array_sort(F.concat("base", "extra"))
    found = found.select(*COLUMNS, spans.alias("spans")).withColumn("clean", secrets.redacted(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") > 0, F.char_length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: bin, bin size and offset."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once its successor's is written."""
    docs, before = _table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
            discarded(*before)
            before = [docs]
    return docs
