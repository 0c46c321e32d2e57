"""Documents to training tokens, in stages; the rows of each are written once, and the next reads those.

The last stage returns doc_id, ids, n_ids and round_trip; the others the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common, decontaminate, jaccard_join, sentencepiece_lattice, toxicity
from lantern.llm.line_dedup import line_dedup
from lantern.llm.queries import TOKENIZER


#: Bytes of an Arrow batch: many stages run in one session, whose executors keep what they once held.
BATCH_BYTES = "2097152b"


def _lean(spark: SparkSession) -> None:
    """Hand texts to the workers in batches of BATCH_BYTES, unless the session sets another size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, common.SPARKS_OWN) in (common.SPARKS_OWN, common.BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of 0.7 or more go; null and empty texts stay."""
    _lean(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the lines whose template recurs; n_chars, if there, follows the text."""
    _lean(spark)
    kept = line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest id; so do rows without an id or without words."""
    _lean(spark)
    return jaccard_join.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go."""
    _lean(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row; null texts have null ids."""
    _lean(spark)
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.Model.load(TOKENIZER))


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_recurring_lines),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("SentencePiece", encode),
]

#: CRF scores, template trees and byte-pair merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))  # stages read their input several times
    return STAGES[-1][1](spark, docs, sf_dir)
