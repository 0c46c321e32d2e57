"""Retrieval for many questions at once, and its evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.functions.text import content_tokens, terms
from lantern.operators import evaluation, lexical
from lantern.operators.graph import small
from lantern.plans.lineage import cut


def question_phrases(cases: DataFrame, question: str = "question", case: str = "case_id", most: int = 14) -> DataFrame:
    """(case, phrase): the first content words of each question, as a ranked question has them."""
    return cases.select(case, F.explode(F.slice(F.array_distinct(content_tokens(F.col(question))), 1, most)).alias("phrase"))


#: Asked (case, phrase) rows that go to every task; joins beyond. Shares of a phrase in a case's score that a task holds at once.
ASKED, HELD = 200_000, 1_000_000


def search_many(docs: DataFrame, asked: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", case: str = "case_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(case, rank, id, bm25) of the best k documents of each case; as lexical.bm25 for each by itself. asked: (case, phrase).

    Texts are read once, for the sought terms' places and the corpus's statistics. A phrase that many cases ask for is looked up
    once. Null texts count as empty documents; ties go to the smaller id.
    """
    asked = cut(asked.groupBy(case, "phrase").agg(F.count("*").alias("times")))
    phrases = asked.select("phrase").distinct().withColumn("w", terms(F.col("phrase"))).where(F.size("w") > 0)
    seen = Observation()
    held = docs.select(F.col(id_col).alias("id"), F.explode(F.array(terms(F.col(text_col)))).alias("w"))
    held = held.withColumn("dl", F.greatest(F.coalesce(F.size("w"), F.lit(0)), F.lit(0))).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
    # Rows of one id are one document, and may lie in several tasks
    once = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if once and asked.count() <= ASKED:
        best = _ranked_in_tasks(held, seen, asked, phrases, k, case, k1, b)
    else:
        best = _scored_by_joins(held, seen, asked, phrases, case, k1, b).withColumn("key", F.round("bm25", 9))  # sums in another order differ in the last places
    order = W.partitionBy(case).orderBy(F.desc("key"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(case, "rank", F.col("id").alias(id_col), "bm25")


def _average(seen: Observation) -> tuple[float, float]:
    n, length = float(seen.get["n"]), seen.get["length"]
    return n, max(length, 1) / max(n, 1.0)


def _ranked_in_tasks(held: DataFrame, seen: Observation, asked: DataFrame, phrases: DataFrame, k: int, case: str, k1: float, b: float) -> DataFrame:
    """(case, id, bm25, key) of the best k of each case among each task's documents. Counts of a document stay in one row, so none are shuffled."""
    spark = held.sparkSession
    words = phrases.groupBy("w").agg(F.collect_list("phrase").alias("phrases")).toArrow()  # no more than asked
    found = cut(lexical.phrase_counts(held, words["w"].to_pylist()))
    n, avg = _average(seen)
    number = spark.createDataFrame(words.select(["phrases"]).append_column("p", pa.array(range(words.num_rows), pa.int32()))).select("p", F.explode("phrases").alias("phrase"))
    df = found.select(F.explode("p").alias("p")).groupBy("p").agg(F.count("*").alias("df"))
    asks = asked.join(number, "phrase").join(df, "p").select(case, "p", "times", "df").toArrow()
    idf = np.log((n - (d := asks["df"].to_numpy()) + 0.5) / (d + 0.5))
    cases = asks[case].combine_chunks().dictionary_encode(null_encoding="encode")
    order = np.argsort(p := asks["p"].to_numpy(), kind="stable")
    weight = asks["times"].to_numpy() * np.where(idf <= 0, 1e-6, idf)
    first = np.searchsorted(p[order], np.arange(words.num_rows + 1))
    sent = spark.sparkContext.broadcast((cases.dictionary, cases.indices.to_numpy()[order].astype(np.int64), weight[order], first))
    most = HELD

    def best_of(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, [("case", "ascending"), ("key", "descending"), ("id", "ascending")], null_placement="at_start"))
        c = rows["case"].to_numpy()
        return rows.filter(pa.array(np.arange(c.size) - np.searchsorted(c, c) < k))

    def score(batches):
        names, of, weight, first = sent.value
        kept, least = None, np.full(len(names), -1.0)  # a case's score at place k so far; no document beneath it can be among the best
        for batch in batches:
            p, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            sizes = batch.column(2).value_lengths().to_numpy()
            dl = np.repeat(batch.column(1).to_numpy(), sizes)
            share, asks = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg)), first[p + 1] - first[p]
            ends = np.cumsum(sizes)
            total = np.concatenate([[0], np.cumsum(asks)])
            begin = 0
            while begin < batch.num_rows:
                start = ends[begin] - sizes[begin]
                stop = max(begin + 1, int(np.searchsorted(total[ends], total[start] + most, "right")))
                span, n = slice(start, ends[stop - 1]), asks[start : ends[stop - 1]]
                at = np.repeat(first[p[span]] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # places in `of` of who asks for each
                row = np.repeat(np.repeat(np.arange(begin, stop), sizes[begin:stop]), n)
                code, pair = np.unique(row * len(names) + of[at], return_inverse=True)
                bm25 = np.bincount(pair, weight[at] * np.repeat(share[span], n), code.size)
                c, key = code % max(len(names), 1), np.round(bm25, 9)
                near = np.flatnonzero(key >= least[c])
                rows = pa.table({"case": c[near], "id": batch.column(0).take(pa.array(code[near] // len(names))), "bm25": bm25[near], "key": key[near]})
                kept = best_of(rows if kept is None else pa.concat_tables([kept, rows]))
                c, key = kept["case"].to_numpy(), kept["key"].to_numpy()
                full = np.flatnonzero(np.arange(c.size) - np.searchsorted(c, c) == k - 1)
                least[c[full]] = key[full]
                begin = stop
        if kept is not None:
            for part in kept.set_column(0, "case", names.take(kept["case"])).combine_chunks().to_batches():
                yield part

    types = {c: held.schema[c].dataType.simpleString() for c in ("id",)} | {"case": asked.schema[case].dataType.simpleString()}
    return found.mapInArrow(score, f"case {types['case']}, id {types['id']}, bm25 double, key double").withColumnRenamed("case", case)


def _scored_by_joins(held: DataFrame, seen: Observation, asked: DataFrame, phrases: DataFrame, case: str, k1: float, b: float) -> DataFrame:
    """(case, id, bm25) of all documents that hold a phrase of a case."""
    words = cut(phrases.select("phrase", F.size("w").alias("size"), F.posexplode("w").alias("place", "term")))
    places = cut(held.select("id", "dl", F.posexplode("w").alias("at", "term")).join(small(words.select("term").distinct()), "term", "left_semi"))
    n, avg = _average(seen)
    met = places.join(small(words), "term")
    single = met.where("size = 1").groupBy("phrase", "id", "dl").agg(F.count("*").alias("tf"))
    starts = met.where("size > 1").groupBy("phrase", "id", "dl", "size", (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("met")).where("met = size")
    found = cut(single.unionByName(starts.groupBy("phrase", "id", "dl").agg(F.count("*").alias("tf"))))
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "phrase").select(case, "phrase", (F.col("times") * F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)).alias("weight"))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avg)))
    return found.select("phrase", "id", share.alias("share")).join(small(weights), "phrase").groupBy(case, "id").agg(F.sum(F.col("weight") * F.col("share")).alias("bm25"))


def evaluate(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row of metrics over all cases. cases: as evaluation.run_cases has them; retrieved: (case_id, rank, document_id, start, end)."""
    graded = evaluation.run_cases(cases, retrieved)
    return evaluation.report(cases.select("case_id"), evaluation.case_metrics(graded))
