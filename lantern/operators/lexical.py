"""Lexical search: boolean and phrase matching, bm25 over whole-corpus statistics."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.text import content_tokens, ngrams, sanitized, spaced_terms, terms, terms_of
from lantern.plans.lineage import cut


def occurrences(spaced: Column, phrase: list[str]) -> Column:
    """Places where the phrase's terms stand in a row, without overlap. spaced: see spaced_terms."""
    sought = "".join(f" {t} " for t in phrase)
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(sought), F.lit("")))) / len(sought)).cast("int")


def phrases_of(query: list[str]) -> list[list[str]]:
    """Terms of each phrase, as the index has them."""
    return [p for q in query if (p := terms_of(q))]


def match_terms(entities: list[str], query: str, most: int = 14) -> list[str]:
    """Phrases of a ranked query: six entities, then the question's content words, no repeats."""
    import re

    from lantern.functions.text import STOP_WORDS

    words = [t for t in re.findall(r"[a-z0-9'-]+", query.lower()) if len(t) > 2 and t not in STOP_WORDS]
    out: list[str] = []
    seen: set[str] = set()
    for phrase, bounded in [(e, False) for e in entities[:6]] + [(w, True) for w in words]:
        if bounded and len(out) >= most:
            break
        phrase = re.sub(r"[^\w\s'-]", "", phrase).strip()
        if phrase and phrase.lower() not in seen:
            seen.add(phrase.lower())
            out.append(phrase)
    return out


def frequencies(docs: DataFrame, text_col: str, phrases: list[list[str]]) -> DataFrame:
    """docs without its text, with dl (terms) and tf (array, one count for each phrase). No shuffle.

    The terms come out of a generator: a projection would be copied into every mention of them.
    """
    held = docs.select(*[c for c in docs.columns if c != text_col], F.explode(F.array(spaced_terms(F.col(text_col)))).alias("_t"))
    terms_held = (F.length("_t") - F.length(F.replace("_t", F.lit(" "), F.lit("")))) / 2
    return held.withColumn("dl", F.coalesce(F.floor(terms_held).cast("int"), F.lit(0))).withColumn("tf", F.array(*(occurrences(F.col("_t"), p) for p in phrases))).drop("_t")


def bm25(docs: DataFrame, query: list[str], text_col: str = "text", scope: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that match any phrase, with `bm25`. The scope filters results, never the statistics.

    Texts are read once: the counts, a few numbers for each row, are written and serve statistics and scores.
    """
    phrases = phrases_of(query)
    counted = cut(frequencies(docs, text_col, phrases))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"), F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(len(phrases)))).alias("_df"))
    found = counted.where(F.exists("tf", lambda t: t > 0))
    found = found.where(scope) if scope is not None else found
    return scored(found.crossJoin(F.broadcast(stats)), len(phrases), k1, b)  # one row


def scored(found: DataFrame, phrases: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """found with `bm25` instead of its counts: tf, dl, and _n, _avg, _df of the corpus."""
    score = F.lit(0.0)
    for i in range(phrases):
        idf = F.log((F.col("_n") - F.col("_df")[i] + 0.5) / (F.col("_df")[i] + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = F.col("tf")[i]
        score = score + idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("_avg"))))
    return found.withColumn("bm25", score).drop("_n", "_avg", "_df", "tf", "dl")


def boolean_and(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """Rows that hold every white-space separated phrase of the query."""
    phrases = phrases_of([q.strip('"') for q in query.split()])
    if not phrases:
        return docs.where("false")
    # Out of a generator, or every phrase would fold and split the text anew
    held = docs.select("*", F.explode(F.array(spaced_terms(F.col(text_col)))).alias("_t"))
    for p in phrases:
        held = held.where(F.contains("_t", F.lit("".join(f" {t} " for t in p))))
    return held.drop("_t")


def postings(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(term, id, tf, positions): the inverted index."""
    rows = docs.select(id_col, F.posexplode(terms(F.col(text_col))).alias("position", "term"))
    return rows.groupBy("term", id_col).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def term_statistics(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(term, df, cf); terms are counted by term alone, within tasks before the shuffle, where ids stand once."""
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        held = docs.select(F.explode(F.array(terms(F.col(text_col)))).alias("w")).where("w is not null")
        # Each place of a term, and once more where it is the first of its text
        marked = F.concat(F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(0).alias("first"))), F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("first"))))
        return held.select(F.explode(marked).alias("m")).groupBy("m.term").agg(F.sum("m.first").alias("df"), F.count_if(F.col("m.first") == 0).alias("cf"))
    words = docs.select(F.explode(terms(F.col(text_col))).alias("term"), id_col)
    return words.groupBy("term", id_col).agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def sought(phrases: list[list[str]]) -> tuple[pa.Array, list]:
    """The words of distinct phrases (lists of terms), sorted, and by number of words: sorted codes of the phrases' beginnings, and the numbers of those that end there (else -1)."""
    words = sorted({w for p in phrases for w in p})
    ids = {w: i for i, w in enumerate(words)}
    levels, state = [], np.zeros(len(phrases), dtype=np.int64)
    for k in range(max(map(len, phrases), default=0)):
        here = np.array([j for j, p in enumerate(phrases) if len(p) > k], dtype=np.int64)
        codes, at = np.unique(state[here] * len(words) + np.array([ids[phrases[j][k]] for j in here]), return_inverse=True)
        state[here] = at
        ends = np.full(codes.size, -1, dtype=np.int64)
        last = np.array([len(phrases[j]) == k + 1 for j in here])
        ends[at[last]] = here[last]
        levels.append((codes, ends))
    return pa.array(words, pa.string()), levels


def _counts(words: pa.Array, levels: list, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, phrase's number, places where it stands), in this order, of texts that are terms joined by spaces. All words are followed at once."""
    split = pc.split_pattern(texts.cast(pa.string()), " ")
    size = split.value_lengths().to_numpy(zero_copy_only=False)
    ids = pc.index_in(split.flatten(), value_set=words).fill_null(-1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(size.size), size)
    at = np.flatnonzero(ids >= 0)
    state, met = np.zeros(at.size, dtype=np.int64), [np.zeros(0, dtype=np.int64)]
    for k, (codes, ends) in enumerate(levels):
        there = at + k < ids.size
        there[there] = (row[at[there] + k] == row[at[there]]) & (ids[at[there] + k] >= 0)
        at, state = at[there], state[there]
        code = state * len(words) + ids[at + k]
        near = np.minimum(np.searchsorted(codes, code), codes.size - 1)
        there = codes[near] == code
        at, state = at[there], near[there]
        whole = ends[state] >= 0
        met.append(row[at[whole]] << 32 | ends[state[whole]])
    code, n = np.unique(np.concatenate(met), return_counts=True)
    return code >> 32, code & 0xFFFFFFFF, n


def phrase_counts(held: DataFrame, phrases: list[list[str]], most: int = 1 << 22) -> DataFrame:
    """(id, dl, p, tf): numbers of the phrases that stand in a text, and how often, of (id, dl, w: terms). No shuffle; texts without any are out.

    The phrases go to every task; how many they are is the caller's to bound. Texts of about `most` bytes are looked through at a time.
    """
    context = held.sparkSession.sparkContext
    sent = context.broadcast(sought(phrases))

    def run(batches):
        for whole in batches:
            part = np.cumsum(pc.binary_length(whole.column(2)).to_numpy().astype(np.int64)) // most
            for start, stop in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]):
                batch = whole.slice(start, stop - start)
                row, number, n = _counts(*sent.value, batch.column(2))
                texts, first = np.unique(row, return_index=True)
                ends = pa.array(np.append(first, row.size).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (number, n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(texts)) for c in (0, 1)), *lists], names=["id", "dl", "p", "tf"])

    joined = held.select("id", F.col("dl").cast("long").alias("dl"), F.coalesce(F.array_join("w", " "), F.lit("")).alias("w"))
    return joined.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, dl long, p array<int>, tf array<int>")


def ngram_overlap(docs: DataFrame, items: DataFrame, n: int, id_col: str = "doc_id", item: str = "item_id", text_col: str = "text", most: int = 4_000_000) -> DataFrame:
    """(item, id, shared): how many different n-grams an item's texts and a document's have in common; those without any are out.

    The n-grams of items of up to `most` characters go to the tasks, which follow them in the texts; n-grams of documents are made beyond.
    """
    grams = items.select(item, F.explode(F.array_distinct(ngrams(terms(F.col(text_col)), n))).alias("g")).distinct()
    if items.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0] > most:
        held = docs.select(id_col, F.explode(F.array_distinct(ngrams(terms(F.col(text_col)), n))).alias("g")).distinct()
        return held.join(grams, "g").groupBy(item, id_col).agg(F.count("*").alias("shared"))
    of = grams.groupBy("g").agg(F.collect_list(F.struct(F.col(item).alias("i"))).alias("of")).toArrow()  # about as many n-grams as characters, at most
    numbered = docs.sparkSession.createDataFrame(of.select(["of"]).append_column("g", pa.array(range(of.num_rows), pa.int32())))
    held = docs.select(F.col(id_col).alias("id"), F.lit(0).alias("dl"), F.explode(F.array(terms(F.col(text_col)))).alias("w"))
    found = phrase_counts(held, [g.split(" ") for g in of["g"].to_pylist()]).select("id", F.explode("p").alias("g")).distinct()
    met = found.join(F.broadcast(numbered), "g").select("id", F.explode("of.i").alias(item))
    return met.groupBy(item, F.col("id").alias(id_col)).agg(F.count("*").alias("shared"))


__all__ = ["bm25", "boolean_and", "content_tokens", "frequencies", "match_terms", "ngram_overlap", "occurrences", "phrase_counts", "phrases_of", "postings", "sanitized", "scored", "sought", "term_statistics"]
