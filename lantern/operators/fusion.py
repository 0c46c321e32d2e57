"""Fusion of the legs, reranking and evidence slots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.plans.lineage import cut

ALPHA = 0.3
CAPS = {"path": 2, "entity": 3}
POOL, RESULTS, EVIDENCE = 24, 20, 6


def blend(lexical: DataFrame, vector: DataFrame, key: str, alpha: float = ALPHA, by_rank: bool = False) -> DataFrame:
    """(key, score, legs): full outer join of lexical (key, bm25) and vector (key, cosine).

    Lexical scores are scaled to 0..1 within the hits, or by rank if asked for or if all are equal.
    """
    every = W.partitionBy()  # hits of one query: 20 rows
    low, high, n = F.min("bm25").over(every), F.max("bm25").over(every), F.count("*").over(every)
    place = F.row_number().over(every.orderBy(F.desc("bm25"), key)) - 1
    decay = (n - place) / n
    scaled = decay if by_rank else F.when(high > low, (F.col("bm25") - low) / (high - low)).otherwise(decay)
    left = lexical.where(F.col(key).isNotNull()).select(key, scaled.alias("_l"))
    right = vector.where(F.col(key).isNotNull()).select(key, F.col("cosine").alias("_v"))
    score = alpha * F.coalesce("_v", F.lit(0.0)) + (1 - alpha) * F.coalesce("_l", F.lit(0.0))
    legs = F.concat_ws("+", F.when(F.col("_v").isNotNull(), "vector"), F.when(F.col("_l").isNotNull(), "fts"))
    return left.join(right, key, "full_outer").select(key, score.alias("score"), legs.alias("legs"))


def graph_score(kind: Column, has_date: Column) -> Column:
    return F.when(kind == "path", 0.95).when(has_date, 0.62).otherwise(0.55)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def rerank_scores(pairs: DataFrame, query_col: str, raw_col: str) -> DataFrame:
    """`rerank`: raw scores, all of a query's through a sigmoid if any is outside 0..1."""
    outside = F.max(((F.col(raw_col) < 0) | (F.col(raw_col) > 1)).cast("int")).over(W.partitionBy(query_col))
    return pairs.withColumn("rerank", F.when(outside == 1, sigmoid(F.col(raw_col))).otherwise(F.col(raw_col)))


def cross_encode(pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]], query: str, text: str, batch: int = 16) -> DataFrame:
    """`raw`: the given model's score of each pair, asked for in batches by Arrow."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        out: list[float] = []
        for a in range(0, len(q), batch):
            out += [float(x) for x in score(q[a : a + batch].tolist(), t[a : a + batch].tolist())]
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("raw", scored(query, text))


def rescore(chunks: DataFrame, score: Callable[[list[str], list[str]], list[float]], query: str, text: str, value: str = "score", id_col: str = "key", pool: int = POOL) -> DataFrame:
    """chunks with `value` of each query's best `pool` rows replaced by the model's; the tail keeps its own. A query's ids stand once."""
    order = F.row_number().over(W.partitionBy(query).orderBy(F.desc(value), id_col))
    # Ids and scores alone are ranked; texts are fetched for the pool, and the tail stays where it is.
    best = cut(chunks.select(query, id_col, value).withColumn("_p", order).where(F.col("_p") <= pool).select(F.col(query).alias("_asked"), F.col(id_col).alias("_named"), "_p"))
    best = F.broadcast(best) if best.count() <= 100_000 else best
    mine = (F.col(query) == F.col("_asked")) & (F.col(id_col) == F.col("_named"))
    head = rerank_scores(cross_encode(chunks.join(best.drop("_p"), mine).drop("_asked", "_named"), score, query, text), query, "raw")
    return head.withColumn(value, F.col("rerank")).drop("raw", "rerank").unionByName(chunks.join(best, mine, "left_anti"))


def used_legs(evidence: DataFrame, cited: DataFrame, case: str, most: int = EVIDENCE) -> DataFrame:
    """(case, leg): legs behind the cited slots of the first `most`; of cases that cite none of them, all of these. evidence: (case, slot, leg)."""
    shown = evidence.where(F.col("slot") <= most)
    hits = shown.join(cited.select(case, "slot").distinct(), [case, "slot"], "left_semi")
    rest = shown.join(hits.select(case).distinct(), case, "left_anti")
    return hits.unionByName(rest).select(case, F.explode(F.split("leg", "[+]")).alias("leg")).distinct()


def graph_quote(name: Column, label: Column, near: Column) -> Column:
    """What an entity shows as evidence: its name, label and four neighbours at most."""
    told = F.array_join(F.slice(F.transform(near, lambda n: n["other"]), 1, 4), ", ")
    return F.concat(name, F.lit(" ("), label, F.lit(")"), F.when(told == "", "").otherwise(F.concat(F.lit(": "), told)))


def path_quote(names: Column) -> Column:
    return F.array_join(names, " -> ")


def longest(tokens: Column) -> Column:
    """The longest token, the first of equals; null of none."""
    return F.get(F.filter(tokens, lambda t: F.length(t) == F.array_max(F.transform(tokens, F.length))), 0)


def merge(results: DataFrame, rescored: Column | None = None) -> DataFrame:
    """Ranked rows of (key, type, score): caps of each type, rescoring of the pool, one row for each key, the best."""
    place = F.row_number().over(W.partitionBy("type").orderBy(F.desc("score"), "key"))
    # Each type under its own literal cap, which Spark keeps within each task before it sorts; a branch without the type is pruned
    capped = [results.where(F.col("type") == kind).withColumn("_p", place).where(F.col("_p") <= cap) for kind, cap in CAPS.items()]
    others = results.where(~F.col("type").isin(list(CAPS)))
    others = others.withColumn("_p", place if rescored is not None else F.lit(None).cast("int"))
    kept = reduce(DataFrame.unionByName, [*capped, others])
    score = F.when((F.col("type") == "chunk") & (F.col("_p") <= POOL), rescored).otherwise(F.col("score")) if rescored is not None else F.col("score")
    order = F.when(F.col("type") == "chunk", 1).otherwise(0)
    kept = kept.withColumn("score", score).withColumn("_o", order)
    once = kept.withColumn("_k", F.row_number().over(W.partitionBy("key").orderBy("_o", F.desc("score")))).where("_k = 1")
    return once.orderBy(F.desc("score"), "_o", "key").limit(RESULTS).drop("_p", "_o", "_k")


def evidence(ranked: DataFrame, most: int = EVIDENCE, cut: int = 600) -> DataFrame:
    """(slot, key, quote): the first rows of distinct keys. ranked: (key, text, score), at most RESULTS rows."""
    once = ranked.groupBy("key").agg(F.max("score").alias("score"), F.min_by("text", F.struct(-F.col("score"), "text")).alias("text"))
    slot = F.row_number().over(W.partitionBy().orderBy(F.desc("score"), "key"))
    return once.withColumn("slot", slot).where(F.col("slot") <= most).select("slot", "key", F.left("text", F.lit(cut)).alias("quote"))
