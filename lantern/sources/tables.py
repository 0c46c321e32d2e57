"""Tables, schemas and the inventory of what to ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "document_id string, slug string, title string, year int, type string, timeline_id string, canonical int, animated int, season int, episode int, imdb_id string, source string, release string, cue_count int, chunk_count int, ingested_at string"
CHUNKS = "chunk_id string, document_id string, scene_i int, cue_start int, cue_end int, start_ms int, end_ms int, text string"
INVENTORY = "slug string, title string, year int, type string, imdb_id string, seasons array<int>, episode_counts map<string,int>, timeline_id string, canonical boolean, animated boolean, notes string, imdb_id_verified boolean"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INVENTORY).json(path, multiLine=True)


def inventory_of(spark: SparkSession, text: str) -> DataFrame:
    """An inventory given as JSON text."""
    return spark.createDataFrame([(text,)], "j string").select(F.explode(F.from_json("j", f"array<struct<{INVENTORY}>>")).alias("e")).select("e.*")


def targets(inventory: DataFrame) -> DataFrame:
    """(slug, season, episode, document_id): a row for each film and each episode that isn't animated."""
    wanted = inventory.where("not coalesce(animated, false)")
    films = wanted.where("type = 'movie'").select("slug", F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"))
    seasons = wanted.where("type = 'series'").select("slug", F.explode("seasons").alias("season"), "episode_counts")
    counts = seasons.select("slug", "season", F.coalesce(F.try_element_at("episode_counts", F.col("season").cast("string")), F.lit(0)).alias("n")).where("n > 0")
    rows = films.union(counts.select("slug", "season", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("episode")))
    name = F.when(F.col("season").isNull(), F.concat(F.lit("doc:"), F.col("slug"))).otherwise(F.format_string("doc:%s_s%02de%02d", "slug", "season", "episode"))
    return rows.withColumn("document_id", name)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of df's documents and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def episodes_by_title(inventory: DataFrame) -> DataFrame:
    return inventory.select("slug", F.aggregate(F.map_values("episode_counts"), F.lit(0), lambda a, x: a + x).alias("episodes"))
