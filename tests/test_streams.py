"""Streams against the batch operators."""

import datetime
import os
import random

from pyspark.sql import functions as F

from lantern.operators import chunking
from lantern.streaming import scenes

SCHEMA = "doc string, cue long, ts timestamp, start_s double, end_s double"


def test_scenes_of_late_cues(spark, tmp_path):
    rng = random.Random(4)
    rows, began = [], datetime.datetime(2024, 1, 1)
    for doc in "ab":
        at = 0.0
        for cue in range(30):
            at += rng.choice([1.0, 2.0, 4.0, 5.5])
            rows.append((doc, cue, began + datetime.timedelta(seconds=at), at, at + 1.0))
    arrived = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 15))  # late, but within the delay
    source = f"{tmp_path}/in"
    for n in range(4):
        part = arrived[n * 15 : n * 15 + 15]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/part{n}")
        os.makedirs(source, exist_ok=True)
        for f in os.listdir(f"{tmp_path}/part{n}"):
            if f.startswith("part-"):
                os.rename(f"{tmp_path}/part{n}/{f}", f"{source}/{n}.json")
                os.utime(f"{source}/{n}.json", (n + 1, n + 1))
    late = [("z", 0, began + datetime.timedelta(hours=1), 0.0, 1.0)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.json(f"{tmp_path}/end")
    for f in os.listdir(f"{tmp_path}/end"):
        if f.startswith("part-"):
            os.rename(f"{tmp_path}/end/{f}", f"{source}/9.json")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scenes.STATE_STORE)
    try:
        cues = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        found = scenes.scenes(cues, "doc", "ts", "20 seconds")
        query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(200)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r["doc"], r["cue"]): r["scene"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = chunking.scenes(spark.createDataFrame(rows, SCHEMA), "doc", ["ts", "cue"], F.col("start_s"), F.col("end_s"))
    assert got == {(r["doc"], r["cue"]): r["scene"] for r in batch.collect()}
