"""Ledgers, caches with a time to live, and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def todo(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose keys are not done."""
    return work.join(done.select(*keys), keys, "left_anti")


def daily_use(ledger: DataFrame, ts: Column, counts: Column, budget: int) -> DataFrame:
    """(utc_day, used, remaining) of requests that count."""
    day = ledger.select(F.date_format(ts, "yyyy-MM-dd").alias("utc_day"), counts.cast("boolean").alias("_c"))
    return day.groupBy("utc_day").agg(F.count_if("_c").alias("used")).withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), F.lit(budget) - F.col("used")))


def latest_success(ledger: DataFrame, key: str, success: Column, order: list[str], value: str) -> DataFrame:
    """(key, value) of the last successful row of each key."""
    return ledger.where(success).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def cache_state(cache: DataFrame, now: Column, hit: Column, ts: str, days: int = 7) -> DataFrame:
    """`state` of cached rows: hits never expire, misses do after `days`."""
    fresh = F.col(ts) > now - F.expr(f"interval {days} days")
    return cache.withColumn("state", F.when(hit, "hit").when(fresh, "miss").otherwise("expired"))
