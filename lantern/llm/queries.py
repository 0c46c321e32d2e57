"""Queries op1 to op13 over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, importance, licenses, nn_descent, repeats, sentencepiece_lattice, toxicity
from .common import table
from .decontaminate import contaminated
from .html_text import html_text
from .jaccard_join import ORACLE as JACCARD_SQL
from .jaccard_join import jaccard_join
from .line_dedup import line_dedup
from .pii_surrogates import pseudonymise
from .secrets import secret_scan

#: A SentencePiece model of the machine's public vocabularies.
TOKENIZER = os.environ.get("LANTERN_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is spark.lantern.pii.key, or one of the session's own that is then forgotten."""
    key = spark.conf.get("spark.lantern.pii.key", None) or token_hex(32)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_key", "group_key")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), sentencepiece_lattice.Model.load(TOKENIZER))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_licenses": op7_licenses,
    "op8_nn_descent": op8_nn_descent,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op6_jaccard_join": JACCARD_SQL, "op7_licenses": licenses.oracle(), "op8_nn_descent": nn_descent.ORACLE, "op11_importance_resampling": importance.ORACLE, "op12_suffix_dedup": repeats.ORACLE, "op13_collocations": collocations.ORACLE}
