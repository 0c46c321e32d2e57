"""Retrieval evaluation: grades, recall, reciprocal rank, nDCG, gold sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.operators.graph import small

DEPTH = 12


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def grade(same_document: Column, has_window: Column, inside: Column, near: Column) -> Column:
    return F.when(~same_document, 0).when(~has_window, 1).when(inside, 3).when(near, 2).otherwise(1)


def case_metrics(ranked: DataFrame, case: str = "case_id", depth: int = DEPTH, evidence: int = 6) -> DataFrame:
    """(case, rr_doc, rr_chunk, evidence6, ndcg, recall columns) of graded rows (case, rank, grade)."""
    top = ranked.where(F.col("rank") <= depth)
    ideal = F.row_number().over(W.partitionBy(case).orderBy(F.desc("grade"), "rank"))
    gain = lambda r: F.col("grade") / F.log2(r + 1)
    held = top.withColumn("_i", ideal)

    def hit(least: int, k: int) -> Column:
        return F.max(F.when((F.col("grade") >= least) & (F.col("rank") <= k), 1).otherwise(0))

    def first(least: int) -> Column:
        return F.coalesce(1 / F.min(F.when(F.col("grade") >= least, F.col("rank"))), F.lit(0.0))

    dcg, best = F.sum(gain(F.col("rank"))), F.sum(gain(F.col("_i")))
    recalls = [hit(g, k).alias(f"{n}_recall_{k}") for n, g in (("doc", 1), ("chunk", 2)) for k in (1, 3, 6, 12)]
    return held.groupBy(case).agg(hit(1, evidence).alias("evidence6"), *recalls, first(1).alias("doc_rr"), first(2).alias("chunk_rr"), F.when(best > 0, dcg / best).otherwise(0.0).alias("ndcg"))


def report(cases: DataFrame, metrics: DataFrame, case: str = "case_id") -> DataFrame:
    """One row of rounded means over all cases; cases without results count as 0. primary is made of rounded parts."""
    held = cases.select(case).join(metrics, case, "left")
    names = [c for c in metrics.columns if c != case]
    means = held.agg(*(F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 4).alias(c) for c in names))
    return means.withColumn("primary_metric", F.round(0.5 * F.col("evidence6") + 0.25 * F.col("chunk_recall_6") + 0.25 * F.col("chunk_rr"), 4))


def stratified(rows: DataFrame, stratum: str, id_col: str, quota: int, seed: str = "7") -> DataFrame:
    """`quota` rows of each stratum in the order of a hash of the id."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")), 256)
    return rows.withColumn("pick", F.row_number().over(W.partitionBy(stratum).orderBy(order, id_col))).where(F.col("pick") <= quota)


def around(rows: DataFrame, group: str, start: str, end: str, id_col: str) -> DataFrame:
    """`previous_end` (latest end before the row's start) and `next_end` (end of the earliest start after its end), strictly.

    Rows may overlap: starts and ends of a group are put in one order, in which each looks back (or ahead).
    """
    def points(own: str, other: str, value: Column) -> DataFrame:
        asks = rows.select(group, F.col(own).alias("_t"), F.lit(0).alias("_o"), F.col(id_col).alias("_id"), F.lit(None).cast(rows.schema[end].dataType).alias("_v"))
        return asks.union(rows.select(group, F.col(other), F.lit(1), F.lit(None).cast(rows.schema[id_col].dataType), value))

    back = W.partitionBy(group).orderBy("_t", "_o").rowsBetween(W.unboundedPreceding, 0)
    before = points(start, end, F.col(end)).withColumn("previous_end", F.max("_v").over(back)).where("_id is not null").select(F.col("_id").alias(id_col), "previous_end")
    # Of equal starts, the least end is the one that is met first.
    ahead = W.partitionBy(group).orderBy(F.desc("_t"), "_o", F.desc("_v")).rowsBetween(W.unboundedPreceding, 0)
    after = points(end, start, F.col(end)).withColumn("next_end", F.last("_v", ignorenulls=True).over(ahead)).where("_id is not null").select(F.col("_id").alias(id_col), "next_end")
    return rows.join(before, id_col).join(after, id_col)


def spaced(rows: DataFrame, group: str, order: str, time: str, most: int = 2, apart: float = 60.0) -> DataFrame:
    """(group, picked): orders of the first rows, each more than `apart` from all picked before. A group's rows are a document's."""
    def step(state: Column, row: Column) -> Column:
        fits = (F.size(state) < most) & F.forall(state, lambda p: F.abs(p[time] - row[time]) > apart)
        return F.when(fits, F.concat(state, F.array(row))).otherwise(state)

    held = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(time).cast("double").alias(time)))).alias("l"))
    return held.select(group, F.transform(F.aggregate("l", F.slice("l", 1, 0), step), lambda p: p[order]).alias("picked"))


def of_length(rows: DataFrame, group: str, text: str, low: int = 150, high: int = 800, fallback: int = 80, few: int = 2) -> DataFrame:
    """Rows with texts of fitting length; in groups with fewer than `few` of them, all of `fallback` characters or more."""
    fits = F.length(text).between(low, high)
    # Counts of groups meet the rows; texts stay where they are
    poor = rows.groupBy(F.col(group).alias("_g")).agg(F.count_if(fits).alias("_n")).where(F.col("_n") < few).drop("_n")
    is_poor = F.col("_p").isNotNull()
    held = rows.join(small(poor.withColumn("_p", F.lit(True))), F.col(group).eqNullSafe(F.col("_g")), "left")
    return held.where(F.when(is_poor, F.length(text) >= fallback).otherwise(fits)).drop("_g", "_p")


def distinct_questions(rows: DataFrame, question: str, id_col: str) -> DataFrame:
    """The first of the questions that are equal but for case and what isn't a word character."""
    key = F.lower(F.regexp_replace(question, r"(?U)\W+", ""))
    return rows.withColumn("_k", key).withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy(id_col))).where("_r = 1").drop("_k", "_r")


def leg_recall(ranked: DataFrame, case: str = "case_id", leg: str = "leg", depth: int = 6) -> DataFrame:
    """(leg, recall): the part of all cases for which a leg's first rows hold the document. ranked: (case, leg, rank, grade)."""
    hits = ranked.groupBy(leg, case).agg(F.max(((F.col("rank") <= depth) & (F.col("grade") >= 1)).cast("int")).alias("_h"))
    cases = ranked.select(case).distinct().agg(F.count("*").alias("_n"))
    return hits.groupBy(leg).agg(F.sum("_h").alias("_h")).crossJoin(F.broadcast(cases)).select(leg, F.round(F.col("_h") / F.col("_n"), 4).alias("recall"))


def run_cases(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Graded rows of all cases at once. cases: (case_id, document_id, start, end, pad); retrieved: (case_id, rank, document_id, start, end)."""
    c = cases.select("case_id", F.col("document_id").alias("_doc"), F.col("start").alias("_s"), F.col("end").alias("_e"), "pad")
    held = retrieved.join(c, "case_id")
    known = F.col("_s").isNotNull() & F.col("_e").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    inside = overlaps(F.col("start"), F.col("end"), F.col("_s"), F.col("_e"))
    near = overlaps(F.col("start"), F.col("end"), F.col("_s") - F.col("pad"), F.col("_e") + F.col("pad"))
    return held.select("case_id", "rank", grade(F.coalesce(F.col("document_id") == F.col("_doc"), F.lit(False)), known, inside, near).alias("grade"))


def answer_checks(answers: DataFrame, text: str = "answer", entity: str = "entity", slots: str = "n_slots") -> DataFrame:
    """`names_entity` (as whole words, in any case), `cites` and `cites_in_range` of answers with the number of their slots."""
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    named = F.expr(f"regexp_like(lower({text}), concat('\\\\b\\\\Q', lower({entity}), '\\\\E\\\\b'))")
    return answers.withColumn("names_entity", named).withColumn("cites", F.size(cited) > 0).withColumn("cites_in_range", (F.size(cited) > 0) & F.forall(cited, lambda n: F.coalesce(n.between(1, F.col(slots)), F.lit(False))))
