"""A training corpus from raw documents: quality, near-duplicates, secrets, mixing, packing.

Every stage but the last takes and returns rows with the columns of
``documents``; a row with a null text or id goes through each by the rules of
the operator that the stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import mixing, neardup, packing, quality, secrets
from earshot.llm.common import checkpointed, release, table


#: Bytes of rows that the JVM and a Python worker hand each other at once. Both hold such a batch whole, for each task.
BATCH_BYTES = 4 << 20


def _lean(spark: SparkSession) -> None:
    """The session exchanges small batches with Python workers from here on. Those, which outlive stages, give freed memory back:
    Arrow takes it from the system, which keeps few arenas."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    own = spark.sparkContext.environment
    own.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    own.setdefault("MALLOC_ARENA_MAX", "2")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to all labels, scores ``LEAST_SCORE`` or more."""
    _lean(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    release(spark)
    scored = quality.score(docs, model, out_col="_quality")
    return scored.where(F.col("_quality") >= quality.LEAST_SCORE).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id in each class of near-duplicates."""
    _lean(spark)
    return neardup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced."""
    found = secrets.findings(docs, checkpointed(secrets.scan_ledger(docs)), out_col="_spans")
    text = F.when(F.size("_spans") > 0, secrets.redacted(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    return _sized(found.withColumn("text", text).select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole pass over a document, and one for the blocks taken of it besides."""
    _lean(spark)
    plan = checkpointed(mixing.mix(docs))
    return _sized(mixing.mixed_texts(docs, plan))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    Workers outlive a stage, so they give back what they have remembered here.
    """
    _lean(spark)
    return packing.packed_documents(docs, keep_words=False)


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Learned scores and consistent samples have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
