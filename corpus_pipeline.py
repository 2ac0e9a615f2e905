"""From documents to training windows: five stages, each an operator of kurtosia.llm.

A stage takes what its predecessor kept; all but the last return the columns of
documents.  Toxic documents go, one document of each near-duplicate group stays,
documents that hold benchmark items go, secrets are replaced by tags, and the rest is
packed.  Rows with null or empty texts are kept until they are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurtosia.llm import decontamination, jaccard_join, packing, secret_scan, toxicity
from kurtosia.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; empty and null texts score as clean ones do, so they stay."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_col=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near duplicates; rows without an id or words are in none and stay, as do rows that repeat a kept id."""
    groups = jaccard_join.jaccard_components(docs)
    others = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty and null texts hold none."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by tags; ``n_chars`` follows the text, null texts keep theirs."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows; an empty or null text is its end token alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL expresses neither the fitted scores of the first stage nor the packing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
