"""The store of documents and their chunks, as keyed tables that a batch updates.

Each function returns the new table; writing it is the caller's (see sources.tables).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(held: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """held with the rows of new: a known key takes all columns of the new row but those of `keep`. Keys are unique in both."""
    rest = [c for c in held.columns if c not in keys]
    a = held.select(*keys, F.struct(*rest).alias("_held"))
    b = new.select(*keys, F.struct(*rest).alias("_new"))
    both = a.join(b, keys, "full_outer")
    newer = lambda c: F.when(F.col("_new").isNull(), F.col(f"_held.{c}")).otherwise(F.col(f"_new.{c}"))
    older = lambda c: F.when(F.col("_held").isNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_held.{c}"))
    return both.select(*(F.col(c) if c in keys else (older if c in keep else newer)(c).alias(c) for c in held.columns))


def upsert_documents(held: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by document_id; the slug stays as it was first written."""
    return upsert(held, new, ["document_id"], keep=("slug",))


def replace_chunks(held: DataFrame, new: DataFrame, document: str = "document_id") -> DataFrame:
    """held with all chunks of new's documents replaced by new's."""
    return held.join(new.select(document).distinct(), document, "left_anti").select(held.columns).unionByName(new.select(held.columns))


def listing(documents: DataFrame, order: list[str]) -> DataFrame:
    return documents.orderBy(*order)


def scan_chunks(chunks: DataFrame, documents: DataFrame, key: str, prefix: str | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Chunks with the columns of their documents, for indexing; those whose key starts with a prefix, a number of them in order."""
    held = chunks.join(documents, key)
    if prefix is not None:
        held = held.where(F.col(key).cast("string").startswith(prefix))
    return held.orderBy(*(order or [key])).limit(limit) if limit is not None else held


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the table for many keys at once; keys that aren't there are left out."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def with_times(rows: DataFrame, chunks: DataFrame, key: str, start_ms: str = "start_ms", end_ms: str = "end_ms") -> DataFrame:
    """rows with start_s and end_s of their chunks, null for rows without one."""
    times = chunks.select(key, (F.col(start_ms) / 1000).alias("start_s"), (F.col(end_ms) / 1000).alias("end_s"))
    return rows.join(times, key, "left")


def without(table: DataFrame, gone: Column) -> DataFrame:
    """The rows of which `gone` is false or null: deletion, as a rewrite."""
    return table.where(~F.coalesce(gone, F.lit(False)))


def repeated(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that aren't unique; empty where the constraint holds."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fuzzy_slug(documents: DataFrame, slug: str, col: str = "slug", id_col: str = "document_id") -> DataFrame:
    """The first document whose slug matches with anything in place of each underscore."""
    pattern = "%".join(part.replace("\\", "\\\\").replace("%", "\\%") for part in slug.split("_"))
    return documents.where(F.col(col).like(pattern)).orderBy(id_col).limit(1)


def best_match(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One candidate for each entry (entry_id, title, year, type): of its year and type, else its type, else of the nearest year, 1 off at most.

    candidates: (entry_id, pos, title, year, type). `verified` if year and type agree or the titles do in 12 characters.
    """
    c = candidates.select("entry_id", "pos", F.col("title").alias("found"), F.col("year").alias("_y"), F.col("type").alias("_t"))
    off = F.abs(F.col("_y") - F.col("year"))
    tier = F.when((F.col("_t") == F.col("type")) & (off == 0), 0).when(F.col("_t") == F.col("type"), 1).when(off <= 1, 2)
    held = entries.join(c, "entry_id").withColumn("tier", tier).where("tier is not null")
    order = F.struct("tier", F.when(F.col("tier") == 2, off).otherwise(0), "pos")
    best = held.groupBy("entry_id", "title").agg(F.min_by(F.struct("pos", "found", "tier"), order).alias("b"))
    same = F.lower(F.left("title", F.lit(12))) == F.lower(F.left("b.found", F.lit(12)))
    return best.select("entry_id", "b.pos", "b.tier", ((F.col("b.tier") == 0) | same).alias("verified"))
