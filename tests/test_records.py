"""Behaviours of the store, the graph leg, models, the web and the runs that the query catalogue doesn't show."""

import json

import pytest
from pyspark.sql import functions as F

from lantern.operators import fusion, graph, index, knowledge, lexical, store, vector
from lantern.plans import models, planner, settings
from lantern.plans.engine import Engine, GraphLeg
from lantern.sources import subtitles, web


def test_upsert_keeps_the_slug(spark):
    held = spark.createDataFrame([("a", "s1", "old"), ("b", "s2", "stays")], "document_id string, slug string, title string")
    new = spark.createDataFrame([("a", "x", None), ("c", "s3", "new")], "document_id string, slug string, title string")
    got = {r["document_id"]: (r["slug"], r["title"]) for r in store.upsert_documents(held, new).collect()}
    assert got == {"a": ("s1", None), "b": ("s2", "stays"), "c": ("s3", "new")}


def test_entities_merge_over_aliases(spark):
    rows = [(1, "Robert Smith", "Character", ["Bob"]), (2, "Bob", "Character", ["Bobby"]), (3, "Bob", "Location", []), (4, "bobby", "Character", []), (5, "Ann", "Character", None)]
    got = {r["entity_id"]: r for r in knowledge.merge_by_alias(spark.createDataFrame(rows, "seq long, name string, kind string, aliases array<string>")).collect()}
    assert set(got) == {"character:robert_smith", "location:bob", "character:ann"}
    assert got["character:robert_smith"]["aliases"] == ["Bob", "Bobby", "bobby"] and got["character:robert_smith"]["name"] == "Robert Smith"
    table = spark.createDataFrame([("x", "X")], "entity_id string, name string")
    assert knowledge.record(table, "x") == {"entity_id": "x", "name": "X"} and knowledge.record(table, "y") is None


def test_corrupt_cache_entries_are_done_again(spark):
    rows = [("a", "ok", '{"entities": []}'), ("b", "ok", "{oops"), ("c", "fail", '{"entities": []}'), ("d", "ok", "[]"), ("e", "ok", None), ("f", "ok", "{}")]
    cache = spark.createDataFrame(rows, "window_id string, status string, body string")
    windows = spark.createDataFrame([(x,) for x in "abcdefg"], "window_id string")
    assert {r[0] for r in knowledge.to_extract(windows, cache, ["window_id"]).collect()} == set("bcdeg")


def test_build_graph_resumes(spark):
    windows = spark.createDataFrame([("d#w1", 1, "one"), ("d#w2", 2, "two"), ("d#w3", 3, "bad")], "window_id string, seq long, text string")
    documents = spark.createDataFrame([("d", "D", "movie", None, "s")], "document_id string, title string, type string, season int, timeline_id string")
    asked = []

    def extract(text):
        if text == "bad":
            raise OSError("gone")
        return json.dumps({"entities": [{"name": f"thing {text}", "type": "Object"}], "events": [{"name": "big meeting", "participants": ["Ann"], "location": "Town hall", "evidence_quote": "they met at last"}]})

    cache = spark.createDataFrame([], "window_id string, status string, body string, seq int")
    out = settings.build_graph(windows, extract, cache, documents, spark.createDataFrame([("timeline:s", None)], "id string, parent string"))
    assert {r["status"]: r["n"] for r in out["totals"].collect()} == {"ok": 2, "error": 1}
    assert {r["id"] for r in out["nodes"].collect()} == {"object:thing_one", "object:thing_two", "event:big_meeting", "character:ann", "location:town_hall"}
    edges = {("character:ann", "PARTICIPATES_IN", "event:big_meeting"), ("event:big_meeting", "OCCURS_AT", "location:town_hall"), ("event:big_meeting", "OCCURS_IN", "timeline:s"), ("event:big_meeting", "DEPICTED_IN", "d")}
    assert {tuple(r)[:3] for r in out["edges"].collect()} == edges and out["loaded"]["chunks"] == 2
    again = settings.build_graph(windows, lambda t: asked.append(t) or "{}", out["cache"])
    assert {r["status"]: r["n"] for r in again["totals"].collect()} == {"ok": 1}


def _graph(spark):
    nodes = spark.createDataFrame([("c1", "Character", "Ann"), ("c2", "Character", "Bob"), ("o1", "Object", "Red key"), ("e1", "Event", "the vault opens"), ("e2", "Event", "the alarm rings"), ("e3", "Event", "the vault shuts")], "id string, label string, name string")
    edges = spark.createDataFrame([("c1", "USES", "o1"), ("c2", "USES", "o1"), ("e1", "BEFORE", "e2"), ("e2", "BEFORE", "e3"), ("c1", "PARTICIPATES_IN", "e1"), ("c2", "KNOWS", "e3"), ("e1", "OCCURS_IN", "timeline:s"), ("e3", "OCCURS_IN", "timeline:s")], "src string, rel string, dst string")
    return nodes, edges


def test_graph_leg(spark):
    nodes, edges = _graph(spark)
    dates = spark.createDataFrame([("e2", None, "year"), ("e3", "", "unknown"), ("e1", "2015", None)], "id string, date string, date_precision string")
    leg = GraphLeg(nodes.join(dates, "id", "left"), edges)
    assert {r["key"]: r["score"] for r in leg.rows(planner.Plan(("vault", "alarm"))).collect()} == {"node:e1": 0.62, "node:e2": 0.62, "node:e3": 0.55}
    names = {r["key"]: r["quote"] for r in leg.rows(planner.Plan(("Ann", "Bob"))).collect()}
    assert names == {"node:c1": "Ann (Character): e1, o1", "node:c2": "Bob (Character): e3, o1"}
    assert [r["key"] for r in leg.rows(planner.Plan(("Ann", "Bob"), scope="s")).collect()] == ["node:c1"]
    paths = leg.rows(planner.Plan(("Ann", "Bob"), operation="find_connection")).collect()
    assert [(r["type"], r["quote"], r["score"]) for r in paths] == [("path", "Ann -> Red key -> Bob", 0.95)]
    assert leg.rows(planner.Plan(("Ann", "Ann"), operation="find_connection")).collect() == []
    after = leg.rows(planner.Plan((), operation="next_events", reference_event="the vault opens")).collect()
    assert [r["key"] for r in after][:1] == ["node:e2"] and {r["score"] for r in after} == {0.62}
    assert [r["key"] for r in leg.rows(planner.Plan((), operation="prev_events", reference_event="alarm rings")).collect()] == ["node:e1"]
    assert leg.rows(planner.Plan()) is None


def test_engine_with_all_legs(spark):
    docs = spark.createDataFrame([(1, "the vault is open", "a"), (2, "Ann left", "b")], "doc_id long, text string, scope string")
    nodes, edges = _graph(spark)
    found = Engine(docs, graph_leg=GraphLeg(nodes, edges), rerank=lambda q, t: [0.9 if "vault" in x else 0.1 for x in t]).ask("Where is Ann in the vault?")
    assert found.legs == {"lexical": "ok", "vector": "empty", "graph": "ok"} and found.used == {"lexical", "graph"}
    assert [e["key"] for e in found.evidence] == [1, "node:c1", 2]
    down = Engine(docs, graph_leg=GraphLeg(nodes.drop("name"), edges)).ask("Where is Ann in the vault?")
    assert down.legs["graph"] == "down" and down.legs["lexical"] == "ok"
    assert Engine(docs).ask("  ") is None

    def broken(question, evidence):
        raise OSError

    assert Engine(docs, answerer=broken).ask("the vault").evidence


def test_rescore_pool(spark):
    rows = spark.createDataFrame([("q", f"k{i}", float(i), "x" * i) for i in range(5)], "q string, key string, score double, t string")
    got = {r["key"]: r["score"] for r in fusion.rescore(rows, lambda q, t: [float(len(x)) / 10 for x in t], "q", "t", pool=2).collect()}
    assert got == pytest.approx({"k4": 0.4, "k3": 0.3, "k2": 2.0, "k1": 1.0, "k0": 0.0})


def test_batch_top_k_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0]), (7, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.batch_top_k(v, v.where("vec_id < 5"), 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 5, (2, 1): 1, (2, 2): 5}


def test_index_equals_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b a"), (3, None), (4, "c")], "doc_id long, text string")
    index.update(docs, str(tmp_path / "i"), "doc_id")
    for query in (["a b", "c"], ["zz"], ["b"]):
        want = {r["doc_id"]: round(r["bm25"], 9) for r in lexical.bm25(docs, query).collect()}
        assert {r["id"]: round(r["bm25"], 9) for r in index.search(spark, str(tmp_path / "i"), query).collect()} == want


def test_shortest_paths_meet_in_the_middle(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d"), ("a", "R", "x"), ("x", "R", "c"), ("d", "R", "e"), ("e", "R", "f"), ("f", "R", "g")], "src string, rel string, dst string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "f"), ("a", "g"), ("a", "none")], "a string, b string")
    got = {(r["a"], r["b"]): r["path"] for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {("a", "d"): ["a", "b", "c", "d"], ("a", "a"): ["a"], ("a", "f"): ["a", "b", "c", "d", "e", "f"]}


def test_chat():
    waits, replies = [], [models.Reply(429, retry_after=90), models.Reply(500), models.Reply(200, "```json\n{bad\n```"), models.Reply(200, '{"entities": ["Ann"]}')]
    chat = models.Chat(lambda m, t: replies.pop(0), sleep=waits.append)
    assert chat.ask_json([{"role": "user", "content": "x"}]) == {"entities": ["Ann"]} and waits == [30.0, 2.0]
    with pytest.raises(models.ModelError, match="402"):
        models.Chat(lambda m, t: models.Reply(402), sleep=waits.append).ask([])
    with pytest.raises(models.ModelError, match="content"):
        models.Chat(lambda m, t: models.Reply(200)).ask([])

    def broken(m, t):
        raise OSError("no line")

    assert models.model_planner(models.Chat(broken, sleep=lambda _: None))("who opened it", "s") == planner.Plan(scope="s")


def test_checked_answer():
    shown = [{"slot": 1, "quote": "q"}]
    assert models.checked_answer("?", [], None, None) == (models.NO_EVIDENCE, None)
    assert models.checked_answer("?", shown, lambda q, e, t: f"{t}", lambda a, e: a == "0.0") == ("0.0", None)
    assert models.checked_answer("?", shown, lambda q, e, t: f"{t}", lambda a, e: False) == ("0.2", models.NOTES["kept"])

    def once(q, e, t):
        if t == 0.0:
            raise OSError
        return "x"

    assert models.checked_answer("?", shown, once, lambda a, e: False) == ("x", models.NOTES["failed"])
    assert models.citation_html("a < b [1] [9]") == 'a &lt; b <a href="#slot-1">[1]</a> [9]'
    assert "SCOPE" in models.evidence_html([{"slot": 1, "quote": "<q>", "scope": "scope"}]) and "&lt;q&gt;" in models.evidence_html([{"slot": 1, "quote": "<q>"}])


def test_web(tmp_path):
    waits, pages = [], [web.Page(503), web.Page(429), web.Page(200, b'[{"url": "u"}, {"x": 1}, 3]')]
    ledger = []
    assert web.search("s", lambda _: pages.pop(0), ledger, 5, sleep=waits.append) == [{"url": "u"}] and waits == [1.0, 2.0] and ledger[0][1] == 200
    assert web.search("s", None, ledger, 0) == [] and web.hits_of("{}") == [] and web.hits_of("no") == []
    with pytest.raises(OSError):
        web.get("u", lambda _: web.Page(404))
    good = "\n\n".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},500\nline {i}" for i in range(160)).encode()
    to = tmp_path / "x" / "a.srt"
    assert web.download("u", str(to), lambda _: web.Page(200, good)) and to.read_bytes() == good
    assert not web.download("u", str(tmp_path / "b.srt"), lambda _: web.Page(200, b"<html>")) and not list(tmp_path.glob("b*"))
    cached = []
    assert web.find(["q1", "q2"], lambda q: [f"{q}-{i}" for i in range(9)], lambda u: u == "q2-4", put=cached.append) == "q2-4" and cached == ["q2-4"]
    assert web.find(["q"], lambda q: [f"{q}-{i}" for i in range(9)], lambda u: u == "q-7", put=cached.append) is None and cached[-1] is None
    assert web.find(["q"], lambda q: ["new"], lambda u: u == "new", cached="old", put=cached.append) == "new" and cached[-2:] == [None, "new"]


def test_parse_again_with_fewer_empty_lines():
    text = "1\n00:00:01,000 --> 00:00:02,000\na\n\n\n\n2\n00:00:03,000 --> 00:00:04,000\nb\n"
    assert [c[3] for c in subtitles.parse(text)] == ["a", "b"]


def test_ingest(spark, tmp_path):
    for name, body in (("a", "Hello there."), ("b", "see netnaija"), ("c", "Stored.")):
        (tmp_path / f"{name}.srt").write_text(f"1\n00:00:01,000 --> 00:00:02,500\n{body}\n")
    stored = spark.createDataFrame([("doc:c",)], "document_id string")
    records, states = settings.ingest(spark, str(tmp_path), stored, lambda p: F.concat(F.lit("doc:"), F.regexp_extract(p, r"([^/]*)\.srt$", 1)))
    assert [(r["chunk_id"], r["start_ms"], r["end_ms"], r["text"]) for r in records.collect()] == [("doc:a#s0000c00001", 1000, 2500, "Hello there.")]
    assert {r["document_id"]: r["state"] for r in states.collect()} == {"doc:a": "ok", "doc:b": "spam"}


def test_settings_reports_and_cases(spark, tmp_path):
    s = settings.Settings.read({"LANTERN_DATA": str(tmp_path), "LANTERN_DAILY_BUDGET": "7"})
    assert s.daily_budget == 7 and s.backend("graph") == f"{tmp_path}/graph" and settings.Settings.read({"LANTERN_GRAPH_URL": "bolt://x"}).backend("graph") == "bolt://x"
    spark.range(3).write.parquet(f"{tmp_path}/graph")
    assert settings.health(spark, s) == {"vectors": None, "graph": 3}
    work = spark.createDataFrame([(1,), (2,)], "id long")
    for _ in range(2):
        settings.resume(work, f"{tmp_path}/out", ["id"], lambda rest: rest.withColumn("q", F.lit("x")))
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    settings.write_report(work, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2
    (tmp_path / "cases.json").write_text(json.dumps([{"case_id": "a", "question": "q", "document_id": "d", "start": 1.5}]))
    assert settings.read_cases(spark, str(tmp_path / "cases.json")) == [settings.Case("a", "q", "d", start=1.5)]
