"""Exact cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.plans.lineage import cut

#: Query vectors compared in one pass over the collection.
QUERIES = 4096
#: Similarities that a task holds at once.
HELD = 2_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scope: Column | None = None) -> DataFrame:
    """The k nearest by cosine, with `score`; ties by id."""
    rows = vectors.where(scope) if scope is not None else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col(vector_col), q)).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def embed(rows: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], kind: str = "passage", prefixed: bool = True, most: int = 2048, batch: int = 64, out: str = "embedding") -> DataFrame:
    """rows with unit vectors of their texts by a given model, asked in batches. Passages are cut; a zero vector stays one."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [(f"{kind}: " if prefixed else "") + (t or "") for t in part]
            found: list = []
            for a in range(0, len(texts), batch):
                x = np.asarray(model(texts[a : a + batch]), dtype=np.float64)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                found += (x / np.where(size > 0, size, 1.0)).tolist()
            yield pd.Series(found)

    text = F.left(F.col(text_col), F.lit(most)) if kind == "passage" else F.col(text_col)
    return rows.withColumn(out, run(text))


def upsert_points(held: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The collection with new points in place of those of their id."""
    return held.join(new.select(key), key, "left_anti").select(held.columns).unionByName(new.select(held.columns))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of the k nearest others of each query.

    Queries go to the tasks in blocks of QUERIES; a task keeps k rows of each query. Null, empty and zero
    vectors, and those of another dimension than a block's, are nobody's neighbours.
    """
    length = F.sqrt(dot(F.col(vector_col), F.col(vector_col)))
    rows = vectors.where(F.col(id_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x)) & (length > 0) & (length < float("inf"))).select(F.col(id_col).cast("long").alias(id_col), vector_col)
    asked = cut(queries.join(rows.select(id_col), id_col, "left_semi").select(F.col(id_col).cast("long").alias("q"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")))
    blocks = max(1, -(-asked.count() // QUERIES))

    def search(names: np.ndarray, unit: np.ndarray):
        def run(batches):
            best: dict[int, list] = {}
            for batch in batches:
                own = batch.column(0).to_numpy()
                x = batch.column(1)
                x = np.array(x.flatten(), dtype=np.float64).reshape(len(own), -1) if len(own) else np.zeros((0, unit.shape[1]))
                if not len(own) or x.shape[1] != unit.shape[1]:
                    continue
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                n, step = min(k, len(own)), max(1, HELD // len(own))
                for a in range(0, len(names), step):
                    sims = unit[a : a + step] @ x
                    sims[names[a : a + step, None] == own[None, :]] = -2
                    least = np.partition(sims, len(own) - n, axis=1)[:, len(own) - n]  # ties with the last all stay
                    for i, j in zip(*np.nonzero((sims >= least[:, None]) & (sims > -2)), strict=True):
                        best.setdefault(a + int(i), []).append((-float(sims[i, j]), int(own[j])))
                    for i in range(a, min(a + step, len(names))):
                        if i in best:
                            best[i] = sorted(best[i])[:k]
            found = [(int(names[i]), o, -s) for i, held in best.items() for s, o in held]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["query_id", id_col, "score"])

        return run

    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about QUERIES rows
        for size in sorted({len(r["v"]) for r in block}) or [1]:
            part = [r for r in block if len(r["v"]) == size]
            unit = np.array([r["v"] for r in part], dtype=np.float64).reshape(len(part), size)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            found = rows.where(F.size(vector_col) == size).mapInArrow(search(np.array([r["q"] for r in part], dtype=np.int64), unit), f"query_id long, {id_col} long, score double")
            out = found if out is None else out.union(found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
