"""Settings from the environment, and the runs that put the operators together."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions.text import clean_cue, has_spam
from lantern.operators import chunking, incremental, knowledge
from lantern.sources import subtitles


@dataclass(frozen=True)
class Settings:
    """Each field may be given as LANTERN_<NAME>."""

    data: str = "data"
    vectors_url: str = ""
    graph_url: str = ""
    model: str = ""
    daily_budget: int = 100
    ttl_days: int = 7

    @classmethod
    def read(cls, environment: dict[str, str] | None = None) -> Settings:
        env = os.environ if environment is None else environment
        return cls(**{f.name: type(f.default)(env[k]) for f in fields(cls) if (k := f"LANTERN_{f.name.upper()}") in env})

    def backend(self, kind: str) -> str:
        """Where a collection lives: a service if one is named, else a folder of the data."""
        return getattr(self, f"{kind}_url", "") or f"{self.data}/{kind}"


def health(spark: SparkSession, settings: Settings, kinds: tuple[str, ...] = ("vectors", "graph")) -> dict[str, int | None]:
    """Rows of each collection; None for one that can't be read."""
    out: dict[str, int | None] = {}
    for kind in kinds:
        try:
            out[kind] = spark.read.parquet(settings.backend(kind)).count()
        except Exception:  # noqa: BLE001  a missing collection is the finding
            out[kind] = None
    return out


def ingest(spark: SparkSession, folder: str, stored: DataFrame, document_of: Callable[[F.Column], F.Column]) -> tuple[DataFrame, DataFrame]:
    """(chunk records, documents with their state) of the subtitle files under folder that aren't stored. Spam is rejected."""
    cues = subtitles.read_cues(spark, folder).withColumn("document_id", document_of(F.col("path")))
    cues = incremental.todo(cues, stored, ["document_id"]).withColumn("text", clean_cue(F.col("text")))
    spam = cues.where(has_spam(F.col("text"))).select("document_id").distinct()
    records = chunking.chunk_records(cues.join(spam, "document_id", "left_anti"), "document_id", "cue", "text", "start_s", "end_s")
    states = cues.select("document_id").distinct().join(spam.withColumn("state", F.lit("spam")), "document_id", "left")
    return records, states.select("document_id", F.coalesce("state", F.lit("ok")).alias("state"))


def build_graph(windows: DataFrame, extract: Callable[[str], str] | None, cache: DataFrame, documents: DataFrame | None = None, scopes: DataFrame | None = None, ledger: DataFrame | None = None, known: DataFrame | None = None) -> dict[str, DataFrame | dict]:
    """Extract what the cache lacks, if an extractor is given, and load what is known, if documents and scopes are. windows: (window_id, seq, text).

    The rest, and what comes back, is as knowledge.load has it; ledger and entities go into the next call.
    """
    out: dict[str, DataFrame] = {"cache": cache}
    if extract is not None:
        run = knowledge.run_extraction(knowledge.to_extract(windows, cache, ["window_id"]), extract)
        fresh = run.withColumn("seq", F.lit(1) + F.coalesce(F.lit(cache.agg(F.max("seq")).first()[0]), F.lit(0)))
        out["cache"] = knowledge.cache_put(cache, fresh.select(cache.columns), ["window_id"], "seq")
        out["totals"] = knowledge.run_totals(run)
    if documents is not None and scopes is not None:
        told = knowledge.cache_get(out["cache"]).where("status = 'ok'").select("window_id", F.col("read").alias("body"))
        loaded = knowledge.load(windows.join(told, "window_id").select("seq", "window_id", "body"), documents, scopes, ledger, known)
        out |= {"loaded" if k == "totals" else k: v for k, v in loaded.items()}
    return out


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    rows.write.mode("overwrite").json(path)


def resume(work: DataFrame, path: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> None:
    """Append what `make` gives for the work that isn't under path yet; safe to call again after a failure."""
    spark = work.sparkSession
    try:
        rest = incremental.todo(work, spark.read.json(path).select(*keys).distinct(), keys)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e) and "UNRESOLVED_COLUMN" not in str(e):
            raise
        rest = work
    made = make(rest)
    if not made.isEmpty():
        made.write.mode("append").json(path)


@dataclass(frozen=True)
class Case:
    """A golden question."""

    case_id: str
    question: str
    document_id: str
    kind: str = "chunk"
    start: float | None = None
    end: float | None = None
    source: str = "generated"


def read_cases(spark: SparkSession, path: str) -> list[Case]:
    """Golden questions of a JSON file, in order; absent fields take their defaults."""
    rows = spark.read.json(path, multiLine=True).orderBy("case_id").toLocalIterator()  # a fixture of some hundred rows
    names = [f.name for f in fields(Case)]
    return [Case(**{n: v for n in names if n in r.asDict() and (v := r[n]) is not None}) for r in rows]
