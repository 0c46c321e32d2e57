"""Citations and the per-sentence faithfulness gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.text import citations, content_words, is_hedge, sentences

LEAST_OVERLAP = 0.2


def cited_slots(answers: DataFrame, id_col: str, answer_col: str) -> DataFrame:
    """(id, slot): distinct citation numbers of each answer."""
    return answers.select(id_col, F.explode(F.array_distinct(citations(F.col(answer_col)))).alias("slot")).where("slot is not null")


def sentence_verdicts(answers: DataFrame, evidence: DataFrame, id_col: str, answer_col: str) -> DataFrame:
    """(id, n, sentence, faithful). evidence: (id, slot, quote), a few rows for each answer."""
    said = answers.select(id_col, F.posexplode(sentences(F.col(answer_col))).alias("n", "sentence")).withColumn("cites", F.array_distinct(citations(F.col("sentence"))))
    shown = evidence.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "quote")))).alias("shown"))
    held = said.join(shown, id_col, "left").withColumn("quotes", F.filter(F.transform("cites", lambda c: F.try_element_at("shown", c)), lambda q: q.isNotNull()))
    bare = F.regexp_replace("sentence", r"\[\d+\]", "")
    words = content_words(bare)
    overlap = F.size(F.array_intersect(words, content_words(F.array_join("quotes", " "))))
    cited = F.size("cites") > 0
    hedge = is_hedge(F.col("sentence"), cited)
    good = F.when(~cited, hedge).when(F.size("quotes") == 0, False).when(hedge, True).when(F.size(words) == 0, False).otherwise(overlap >= LEAST_OVERLAP * F.size(words))
    return held.select(id_col, "n", "sentence", F.coalesce(good, F.lit(False)).alias("faithful"))


def source_titles(claimed: DataFrame, cited: DataFrame, evidence: DataFrame, id_col: str) -> DataFrame:
    """(id, titles): claimed titles that were shown, in order, then titles of cited slots. claimed: (id, n, title); cited: (id, slot); evidence: (id, slot, title)."""
    first = claimed.join(evidence.select(id_col, "title").distinct(), [id_col, "title"], "left_semi").select(id_col, "title", F.col("n").alias("o"))
    second = evidence.join(cited, [id_col, "slot"], "left_semi").select(id_col, "title", (F.col("slot") + 1000).alias("o"))
    once = first.union(second).groupBy(id_col, "title").agg(F.min("o").alias("o"))
    return once.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "title"))), lambda x: x["title"]).alias("titles"))


def answer_sections(block: Column) -> tuple[Column, Column, Column]:
    """ANSWER, UNCERTAINTY and SOURCES of a labelled block."""
    def section(name: str) -> Column:
        return F.trim(F.regexp_extract(block, rf"(?s){name}:\s*(.*?)(?=\n(?:ANSWER|UNCERTAINTY|SOURCES):|$)", 1))

    sources = F.filter(F.transform(F.split(section("SOURCES"), "[;,]"), lambda s: F.btrim(s, F.lit(" ,.\n"))), lambda s: s != "")
    return section("ANSWER"), section("UNCERTAINTY"), sources
