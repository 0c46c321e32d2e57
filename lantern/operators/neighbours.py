"""Approximate nearest neighbours by inverted lists: vectors under the k-means centroid that is nearest, of which a question reads a few.

Under a folder: `centres` (list, centre, size), a few thousand rows, and `vectors` (id, v: unit vector), a part for each list.
What is found is ranked exactly. `recall` compares with the exact search for a sample of questions, in each run that asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.operators.vector import batch_top_k, dot

#: Lists at most; their centres go to every task. Vectors and questions that a task compares at once.
MOST_LISTS, BLOCK, ASKED = 4096, 20_000, 4096


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with vectors of length 1 in double precision; null, zero and odd vectors are left out."""
    length = F.sqrt(dot(F.col(vector_col), F.col(vector_col)))
    rows = vectors.where(F.col(id_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"), length.alias("_l"))
    return rows.where((F.col("_l") > 0) & (F.col("_l") < float("inf"))).select("id", F.transform("_v", lambda x: x.cast("double") / F.col("_l")).alias("v"))


def build(vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 100_000, rounds: int = 10, seed: int = 1) -> None:
    """Write the lists: as many as the root of the number of vectors, unless told. Centres are fitted on about `sample` vectors at most; all vectors are filed."""
    spark, rows = vectors.sparkSession, unit_vectors(vectors, id_col, vector_col)
    n = rows.count()
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)), max(1, n))
    if n:
        shown = (rows if n <= sample else rows.sample(sample / n, seed)).select(array_to_vector("v").alias("features"))
        centres = np.array(KMeans(k=lists, maxIter=rounds, seed=seed).fit(shown).clusterCenters())
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    else:
        centres = np.zeros((1, 1))
    known = spark.sparkContext.broadcast(centres)

    def file(batches):
        for batch in batches:
            v = batch.column("v")
            x = np.array(v.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            near = (x @ known.value.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "v", "list"])

    # Salted, so that a crowded list isn't written by one task
    filed = rows.mapInArrow(file, "id long, v array<double>, list int").repartition("list", F.pmod(F.xxhash64("id"), F.lit(4)))
    filed.write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    sizes = dict(_vectors(spark, path).groupBy("list").agg(F.count("*")).collect())  # a row for each list
    rows = [(i, c.tolist(), sizes.get(i, 0)) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "list int, centre array<double>, size long").write.mode("overwrite").parquet(f"{path}/centres")


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, v array<double>, list int").parquet(f"{path}/vectors")


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect())  # MOST_LISTS at most
    return np.array([r["centre"] for r in rows]), np.array([r["size"] for r in rows])


def probed(unit: np.ndarray, centres: np.ndarray, sizes: np.ndarray, share: float) -> list[np.ndarray]:
    """For each unit vector the nearest lists, as many as hold `share` of all vectors at most, and one at least."""
    order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")
    read = np.cumsum(sizes[order], axis=1)
    return [o[: max(1, int(np.searchsorted(r, share * sizes.sum(), side="right")))] for o, r in zip(order, read, strict=True)]


def search(spark: SparkSession, path: str, query: list[float], k: int = 10, share: float = 0.1) -> DataFrame:
    """(id, score) of the best k by cosine in the lists that are read."""
    unit = np.array(query, dtype=np.float64)
    unit = unit / max(np.linalg.norm(unit), 1e-12)
    lists = [int(x) for x in probed(unit[None, :], *_centres(spark, path), share)[0]]
    rows = _vectors(spark, path).where(F.col("list").isin(lists))  # of partitions, so the others aren't read
    return rows.select("id", dot(F.col("v"), F.array(*map(F.lit, unit.tolist()))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, share: float = 0.1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of the best k of each query without the vector of its own id. Questions go to the tasks of the lists they read."""
    centres, sizes = _centres(spark, path)
    known = spark.sparkContext.broadcast((centres, sizes))

    def ask(batches):
        for batch in batches:
            x = np.array(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            lists = probed(x, *known.value, share) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["id", "v", "lists"])

    asked = unit_vectors(queries, id_col, vector_col).mapInArrow(ask, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    blocks = spark.read.parquet(f"{path}/centres").select("list", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    held = _vectors(spark, path).join(F.broadcast(blocks), "list")  # a row for each list
    crowd = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns"))
    held = held.join(F.broadcast(crowd), "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "v")
    asked = asked.join(F.broadcast(crowd), "list").join(F.broadcast(blocks), "list").where("blocks > 0")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("turns")).alias("turn"), F.col("id").alias("q"), "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            own, names = left.column("id").to_numpy(), right.column("q").to_numpy()
            x, q = (np.array(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1) for t in (left, right))
            sims = q @ x.T
            sims[names[:, None] == own[None, :]] = -2
            n = min(k, own.size)
            least = np.partition(sims, own.size - n, axis=1)[:, own.size - n]  # ties with the last stay
            i, j = np.nonzero((sims >= least[:, None]) & (sims > -2))
            out = [names[i], own[j], sims[i, j]]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["list", "block", "turn"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, "query_id long, id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(vectors: DataFrame, queries: DataFrame, found: DataFrame, k: int, audit: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of the exact search's neighbours that `found` has, over `audit` of the queries at most; 1 if there are none."""
    some = queries.orderBy(F.xxhash64(id_col)).limit(audit)
    exact = batch_top_k(vectors.select(id_col, vector_col), some.select(id_col, vector_col), k, id_col, vector_col).select("query_id", F.col(id_col).alias("id"))
    met = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    share = met.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return 1.0 if share is None else float(share)
