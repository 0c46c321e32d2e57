"""A question over three legs: lexical, vector and graph; each may be ok, empty or down."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.text import STOP_WORDS
from lantern.operators import fusion, graph, grounding, index, lexical, names, vector

from .models import NO_EVIDENCE, checked_answer
from .planner import Plan, plan

log = logging.getLogger(__name__)
HITS, NEAREST, NAMES, REACHED, PATHS = 20, 10, 4, 20, 3
GRAPH_ROWS = "key string, type string, score double, quote string"


@dataclass
class Answer:
    plan: Plan
    legs: dict[str, str]
    evidence: list[dict]
    text: str
    used: set[str] = field(default_factory=set)
    note: str | None = None
    sources: list[str] = field(default_factory=list)


def content_words(text: str) -> list[str]:
    """Content tokens of a question's part, as operators.lexical has them."""
    return [w.lower() for p in lexical.match_terms([], text, 1 << 30) for w in [p] if w.lower() not in STOP_WORDS]


class GraphLeg:
    """Entities with neighbours, events before or after one, and connections, as a plan asks for. nodes: (id, label, name), events with a date and date_precision if they are known; edges: (src, rel, dst). A scope's node is `timeline:` and its name."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, ranks: dict[str, int] = graph.LABEL_RANK):
        self.nodes, self.edges, self.ranks = nodes, edges, ranks

    def rows(self, p: Plan) -> DataFrame | None:
        """(key, type, score, quote) of at most a few dozen rows."""
        if p.operation in ("next_events", "prev_events") and p.reference_event:
            return self.events(p.reference_event, backward=p.operation == "prev_events")
        if p.operation == "find_connection" and len(p.entities) >= 2:
            return self.connection(*p.entities[:2])
        return self.entities(list(p.entities[:NAMES]), p.scope) if p.entities else None

    def entities(self, wanted: list[str], scope: str | None = None) -> DataFrame:
        found = names.lookup(self.nodes, self.nodes.sparkSession.createDataFrame([(n,) for n in wanted], "name string"), self.ranks)
        if scope is not None:
            found = graph.witnesses(found, self.edges, self.nodes, scope if scope.startswith("timeline:") else f"timeline:{scope}")
        known = F.lit(False)
        if "date" in self.nodes.columns:
            known = F.coalesce(F.col("date"), F.lit("")) != ""
        if "date_precision" in self.nodes.columns:
            known = known | (F.coalesce("date_precision", F.lit("unknown")) != "unknown")
        named = found.select("id", "label").distinct().join(self.nodes.select("id", "name", known.alias("known")), "id")
        told = fusion.graph_quote(F.col("name"), F.col("label"), F.col("neighbours"))
        dated = (F.col("label") == "Event") & F.col("known")
        return graph.neighbours(named, self.edges).select(F.concat(F.lit("node:"), "id").alias("key"), F.lit("entity").alias("type"), fusion.graph_score(F.lit("entity"), dated).alias("score"), told.alias("quote"))

    def events(self, reference: str, backward: bool = False, hops: int = 3) -> DataFrame:
        """Events up to some steps after (or before) those whose names hold the reference's longest word; half of its words must be in theirs."""
        words = content_words(reference)
        seed = max(words, key=len, default="")
        events = self.nodes.where("label = 'Event'")
        starts = events.where(F.contains(F.lower("name"), F.lit(seed))).select("id") if seed else events.where("false").select("id")
        hits = F.size(F.filter(F.array(*map(F.lit, words or [""])), lambda w: F.contains(F.lower("name"), w)))
        near = starts.join(events.where(hits >= max(1, len(words) // 2)).select("id"), "id", "left_semi")
        reached = graph.walk(self.edges.where("rel = 'BEFORE'"), near, hops, backward).groupBy(F.col("node").alias("id")).agg(F.min("hop").alias("hop"))
        told = reached.join(events, "id").orderBy("hop", "id").limit(REACHED)
        return told.select(F.concat(F.lit("node:"), "id").alias("key"), F.lit("entity").alias("type"), fusion.graph_score(F.lit("entity"), F.lit(True)).alias("score"), F.concat("name", F.lit(" (Event)")).alias("quote"))

    def connection(self, first: str, second: str) -> DataFrame:
        """Shortest paths between the two best nodes of either name; none if the names share a node."""
        ends = [graph.endpoint_candidates(self.nodes, n, content_words(n), self.ranks, 2).select("id") for n in (first, second)]
        shared = ends[0].join(ends[1], "id", "left_semi").limit(1).count()
        pairs = ends[0].select(F.col("id").alias("a")).crossJoin(ends[1].select(F.col("id").alias("b")))  # 2 x 2
        paths = graph.shortest_paths(self.edges, pairs.where(F.lit(not shared))).orderBy("hops", "a", "b").limit(PATHS)
        steps = paths.select("a", "b", F.posexplode("path").alias("n", "id")).join(self.nodes.select("id", "name"), "id")
        names = steps.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("names"))
        return names.select(F.concat(F.lit("path:"), "a", F.lit("-"), "b").alias("key"), F.lit("path").alias("type"), F.lit(0.95).alias("score"), fusion.path_quote(F.col("names")).alias("quote"))


class Engine:
    """docs: (doc_id, text, scope), with a title if there is one; vectors: (doc_id, embedding); models are given as functions.

    index_path: an index of docs with their scopes (operators.index), which the lexical leg then asks instead of the texts.
    """

    def __init__(
        self, docs: DataFrame, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, planner: Callable[[str, str | None], Plan] = plan,
        answerer: Callable[[str, list[dict]], str] | None = None, graph_leg: GraphLeg | None = None, rerank: Callable[[list[str], list[str]], list[float]] | None = None, seconds: float = 8.0, index_path: str | None = None,
    ):
        self.index_path = index_path
        self.docs, self.vectors, self.embed, self.planner, self.graph, self.rerank, self.seconds = docs, vectors, embed, planner, graph_leg, rerank, seconds
        self.answerer = answerer or (lambda question, evidence: " ".join(f"{e['quote'][:200]} [{e['slot']}]" for e in evidence[:2]))

    def _leg(self, name: str, make: Callable[[], DataFrame | None]) -> tuple[str, list]:
        """State and rows of a leg; a failure doesn't reach the others. A few dozen rows come to the driver."""
        try:
            found = make()
            rows = found.collect() if found is not None else []
        except Exception:  # noqa: BLE001  a leg that fails is down
            log.exception("the %s leg is down", name)
            return "down", []
        return ("ok" if rows else "empty"), rows

    def _graph(self, p: Plan) -> DataFrame | None:
        """The graph's rows; its jobs are cancelled when the time is up."""
        if self.graph is None:
            return None
        from threading import Timer

        context, tag = self.docs.sparkSession.sparkContext, f"graph-{id(p)}"
        context.addJobTag(tag)
        timer = Timer(self.seconds, context.cancelJobsWithTag, [tag])
        timer.start()
        try:
            found = self.graph.rows(p)
            return None if found is None else self.docs.sparkSession.createDataFrame([tuple(r) for r in found.collect()], GRAPH_ROWS)
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def ask(self, question: str, scope: str | None = None) -> Answer | None:
        """None for a blank question. A given scope stands over the plan's."""
        if not question.strip():
            return None
        p = self.planner(question, scope)
        scope = scope or p.scope
        within: Column | None = F.col("scope") == scope if scope else None
        phrases = lexical.match_terms(list(p.entities), question)
        spark = self.docs.sparkSession

        def low():
            if not lexical.phrases_of(phrases):
                return None
            if self.index_path:
                return index.search(spark, self.index_path, phrases, HITS, scope).select(F.col("id").alias("doc_id"), "bm25")
            return lexical.bm25(self.docs, phrases, scope=within).orderBy(F.desc("bm25"), "doc_id").limit(HITS).select("doc_id", "bm25")

        def near():
            if self.vectors is None or self.embed is None:
                return None
            rows = self.vectors.join(self.docs.select("doc_id", "scope"), "doc_id") if within is not None else self.vectors
            return vector.top_k(rows, self.embed(question), NEAREST, "doc_id", scope=within).select("doc_id", F.col("score").alias("cosine"))

        legs = [("lexical", low, "doc_id long, bm25 double"), ("vector", near, "doc_id long, cosine double")]
        if self.graph is not None:
            legs.append(("graph", lambda: self._graph(p), GRAPH_ROWS))
        states, tables = {}, {}
        for name, make, schema in legs:
            states[name], rows = self._leg(name, make)
            tables[name] = spark.createDataFrame([tuple(r) for r in rows], schema)
        ranked = fusion.blend(tables["lexical"], tables["vector"], "doc_id")
        titled = F.col("title") if "title" in self.docs.columns else F.lit(None).cast("string")
        chunks = self.docs.select("doc_id", "text", titled.alias("title")).join(F.broadcast(ranked), "doc_id")  # 30 rows at most
        chunks = chunks.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.lit("chunk").alias("type"), "score", F.col("text").alias("quote"), "legs", "title")
        if self.rerank is not None:
            chunks = fusion.rescore(chunks.withColumn("_q", F.lit(question)), self.rerank, "_q", "quote").drop("_q")
        if "graph" in tables:
            chunks = tables["graph"].withColumns({"legs": F.lit("graph"), "title": F.lit(None).cast("string")}).unionByName(chunks.select("key", "type", "score", "quote", "legs", "title"))
        best = fusion.merge(chunks)
        rows = best.select("key", "score", "legs", "title", F.left("quote", F.lit(600)).alias("quote")).collect()  # RESULTS at most
        rows = sorted(rows, key=lambda r: -r["score"])
        shown = [{"slot": n, "key": int(r["key"][4:]) if r["key"].startswith("doc:") else r["key"], "quote": r["quote"], "legs": r["legs"], "title": r["title"] or r["key"]} for n, r in enumerate(rows[: fusion.EVIDENCE], 1)]
        if not shown:
            return Answer(p, states, shown, NO_EVIDENCE)
        try:
            text, note = checked_answer(question, shown, lambda q, e, _: self.answerer(q, e), self._faithful)
        except Exception:  # noqa: BLE001  the evidence is worth showing without an answer
            log.exception("no answer was written")
            return Answer(p, states, shown, "The answer could not be written; see the evidence.", used_legs("", shown))
        return Answer(p, states, shown, text, used_legs(text, shown), note, self._sources(text, shown))

    def _answer(self, text: str) -> DataFrame:
        """(id, answer, sources) of an answer, by itself or in a labelled block."""
        rows = self.docs.sparkSession.createDataFrame([(0, text)], "id int, said string")
        answer, _, sources = grounding.answer_sections(F.col("said"))
        return rows.select("id", F.when(answer == "", F.col("said")).otherwise(answer).alias("answer"), sources.alias("sources"))

    def _faithful(self, text: str, shown: list[dict]) -> bool:
        """Whether the evidence bears each sentence."""
        quotes = self.docs.sparkSession.createDataFrame([(0, e["slot"], e["quote"] or "") for e in shown], "id int, slot int, quote string")
        return grounding.sentence_verdicts(self._answer(text), quotes, "id", "answer").where("not faithful").isEmpty()

    def _sources(self, text: str, shown: list[dict]) -> list[str]:
        """Titles that the answer claims and that were shown, then those of the slots it cites; documents without a title go by their key."""
        answer = self._answer(text)
        titled = self.docs.sparkSession.createDataFrame([(0, e["slot"], e["title"]) for e in shown], "id int, slot int, title string")
        found = grounding.source_titles(answer.select("id", F.posexplode("sources").alias("n", "title")), grounding.cited_slots(answer, "id", "answer"), titled, "id").first()
        return found["titles"] if found else []


def used_legs(text: str, shown: list[dict]) -> set[str]:
    """Legs behind the cited slots, or behind all if none is cited."""
    cited = [e for e in shown if f"[{e['slot']}]" in text]
    names = {"fts": "lexical", "vector": "vector", "graph": "graph"}
    return {names[leg] for e in cited or shown for leg in e["legs"].split("+") if leg}


def status_line(legs: dict[str, str], used: set[str]) -> str:
    """One line on the legs' health, in a fixed order."""
    order = [k for k in ("graph", "vector", "lexical") if k in legs]
    if all(legs[k] == "down" for k in order):
        return "ALL LEGS DOWN"
    words = {k: "DOWN" if legs[k] == "down" else "used" if k in used else "NO FILES" if legs[k] == "empty" else "searched" for k in order}
    degraded = "DEGRADED: " if "DOWN" in words.values() else ""
    return degraded + " | ".join(f"{k} {w}" for k, w in words.items())
