"""Ledgers as streams: daily use of a budget, and idempotent upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W


def daily_use(ledger: DataFrame, ts: str = "ts", status: str = "status", late: str = "1 hour") -> DataFrame:
    """(day, used) of successful requests, in UTC days; rows later than `late` are dropped. ledger: a stream."""
    return ledger.withWatermark(ts, late).where(F.col(status) == 200).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("used")).select(F.col("w.start").alias("day"), "used")


def _remove(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def _exists(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def _state(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The version that holds each bucket after a batch; a row for each bucket."""
    at = f"{path}/state/n={number}"
    return dict(map(tuple, spark.read.schema("bucket int, version long").parquet(at).collect())) if number >= 0 and _exists(spark, at) else {}


def _rows(spark: SparkSession, path: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    places = [f"{path}/data/v={v}/_bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def upsert_stream(rows: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 64):
    """Start a query that keeps one row for each key under path, the last by `order`; of equals the newer. Read it by `upserted`.

    A batch writes the buckets that its keys fall into, as its own version, and then which version holds each
    bucket. Versions that the batch before made superfluous go. A batch that is repeated after a failure starts
    from the state before it, so nothing counts twice and readers see whole batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _state(spark, path, number - 1)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # `buckets` at most
        held = _rows(spark, path, {b: before[b] for b in touched if b in before}, batch.schema)
        both = held.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1))).withColumn("_bucket", bucket).repartition("_bucket")
        last = W.partitionBy("_bucket", key).orderBy(F.desc(order), F.desc("_new"))
        kept = both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_new")
        kept.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={number}")
        after = {**before, **dict.fromkeys(touched, number)}
        spark.createDataFrame(list(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/n={number}")
        batch.unpersist()
        for b, v in _state(spark, path, number - 2).items():
            if before.get(b) != v:
                _remove(spark, f"{path}/data/v={v}/_bucket={b}")
        _remove(spark, f"{path}/state/n={number - 2}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows that upsert_stream keeps under path, after its last whole batch."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, f"{path}/state"):
        return spark.createDataFrame([], schema)
    number = spark.read.schema("bucket int, version long, n int").parquet(f"{path}/state").agg(F.max("n")).first()[0]
    return _rows(spark, path, _state(spark, path, -1 if number is None else number), schema)
