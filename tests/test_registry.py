"""Registration in order against a plain sequential version, and loading by way of it."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lantern.operators import knowledge

ROWS = "seq long, name string, kind string, aliases array<string>"


def canonical(kind, name):
    words = [w for w in re.sub("[^a-z0-9 ]", "", name.lower()).split() if w not in ("the", "a", "an", "of")]
    return f"{kind.lower()}:{'_'.join(words) or name.strip().lower()}"


def replay(mentions, known=()):
    """One by one, with a list of candidates for each alias."""
    held, index, out = {}, {}, {}

    def hear(alias, i):
        key = alias.strip().lower()
        if key and i not in index.setdefault(key, []):
            index[key].append(i)

    for i, name, kind, aliases in sorted(known):
        held[i] = [name.strip(), kind, set(aliases)]
        for a in [name, *aliases]:
            hear(a, i)
    for seq, name, kind, aliases in sorted(mentions):
        i = canonical(kind, name)
        if i not in held:
            same = [c for c in index.get(name.strip().lower(), []) if held[c][1].lower() == kind.lower()]
            i = same[0] if same else i
        if i not in held:
            held[i] = [name.strip(), kind, set()]
        held[i][2] |= set(aliases or [])
        for a in [held[i][0], *held[i][2]]:
            hear(a, i)
        out[seq] = i
    return out, {i: (n, k, sorted(a)) for i, (n, k, a) in held.items()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = ["Tony", "The Tony", "Iron Man", "iron  man", "Stark", "Shield", "shield!", "X", "the", "Steve", "Cap", "A B"]
    mentions = [(n, rng.choice(names), rng.choice(["Character", "Object", "character"]), rng.choice([None, []]) or rng.sample(names, rng.randrange(0, 3))) for n in range(120)]
    known = [("character:stark", "Stark", "Character", ["Iron Man"]), ("object:s1", "Shield", "Object", ["X", "Cap"])] if seed else []
    before = spark.createDataFrame(known, "entity_id string, name string, kind string, aliases array<string>") if known else None
    outcomes, entities = knowledge.register_in_order(spark.createDataFrame(mentions, ROWS).repartition(3), before)
    want, held = replay(mentions, known)
    assert {r["seq"]: r["entity_id"] for r in outcomes.collect()} == want
    assert {r["entity_id"]: (r["name"], r["kind"], r["aliases"]) for r in entities.collect()} == held


def test_chains_of_aliases(spark):
    """Each name was an alias of the one before: all are the first."""
    mentions = [(n, f"name {n}", "Character", [f"name {n + 1}"]) for n in range(40)]
    outcomes, entities = knowledge.register_in_order(spark.createDataFrame(mentions, ROWS))
    assert {r["entity_id"] for r in outcomes.collect()} == {"character:name_0"} and entities.count() == 1


QUOTE = "a quoted line"


def window(n, entities=(), events=(), relations=(), temporals=(), doc="d"):
    body = {"entities": list(entities), "events": list(events), "relations": list(relations), "temporals": list(temporals)}
    return n, f"{doc}#w{n}", json.dumps(body)


def loaded(spark, rows, **more):
    x = spark.createDataFrame(rows, "seq long, window_id string, raw string").select("seq", "window_id", knowledge.read_extraction(F.col("raw")).alias("body"))
    documents = spark.createDataFrame([("d", "D", "movie", None, "main")], "document_id string, title string, type string, season int, timeline_id string")
    scopes = spark.createDataFrame([("timeline:main", None)], "id string, parent string")
    return knowledge.load(x, documents, scopes, **more)


def test_load(spark):
    event = {"name": "The Heist", "participants": ["Scott", "Ant-Man"], "objects": ["Suit"], "location": "Vault", "date": "2015", "date_precision": "year", "evidence_quote": QUOTE}
    rows = [
        window(1, [{"name": "Scott", "type": "Character", "aliases": ["Ant-Man"]}], [event], [{"source": "Scott", "relation": "KNOWS", "target": "Hope", "evidence_quote": QUOTE}, {"source": "Scott", "relation": "KNOWS", "target": "Ant-Man", "evidence_quote": QUOTE}]),
        window(2, temporals=[{"event_a": "alpha", "event_b": "omega", "relation": "AFTER", "evidence_quote": QUOTE}, {"event_a": "alpha", "event_b": "Alpha", "relation": "BEFORE", "evidence_quote": QUOTE}]),
        window(3, [{"name": "12", "type": "Character"}]), (4, "d#w4", "no json"), window(5, [{"name": "Lost", "type": "Object"}], doc="unknown"),
    ]
    got = loaded(spark, rows)
    assert {(r["id"], r["label"]) for r in got["nodes"].collect()} == {("character:scott", "Character"), ("event:heist", "Event"), ("object:suit", "Object"), ("location:vault", "Location"), ("character:hope", "Character"), ("event:alpha", "Event"), ("event:omega", "Event")}
    edges = {(r["src"], r["rel"], r["dst"]): r["provenance"] for r in got["edges"].collect()}
    assert set(edges) == {("character:scott", "PARTICIPATES_IN", "event:heist"), ("event:heist", "INVOLVES", "object:suit"), ("event:heist", "OCCURS_AT", "location:vault"), ("character:scott", "KNOWS", "character:hope"), ("event:omega", "BEFORE", "event:alpha"), ("event:heist", "OCCURS_IN", "timeline:main"), ("event:heist", "DEPICTED_IN", "d")}
    assert json.loads(edges["event:omega", "BEFORE", "event:alpha"]) == {"chunk_id": "d#w2", "document_id": "d", "source": "D", "source_type": "movie", "timeline_id": "main"}
    assert [tuple(r) for r in got["events"].collect()] == [("event:heist", "2015", "year", QUOTE)]
    assert got["totals"] == {"chunks": 2, "entities": 1, "events": 1, "relations": 2, "temporals": 2, "skipped": 3}
    assert {tuple(r) for r in got["ledger"].collect()} == {("d#w1", "default"), ("d#w2", "default")}
    assert [(r["id"], r["label"]) for r in got["documents"].collect()] == [("d", "Movie")]
    again = loaded(spark, [*rows, window(6, [{"name": "Ant-Man", "type": "Character", "aliases": ["Lang"]}])], ledger=got["ledger"], known=got["entities"])
    assert again["totals"]["chunks"] == 1 and [(r["id"], r["aliases"]) for r in again["nodes"].collect()] == [("character:scott", ["Ant-Man", "Lang"])]


def test_load_reads_its_input_once(spark, tmp_path):
    rows = [window(n, [{"name": f"n {n}", "type": "Object"}]) for n in range(5)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    x = spark.createDataFrame(rows, "seq long, window_id string, raw string").mapInArrow(count, "seq long, window_id string, raw string")
    documents = spark.createDataFrame([("d", "D", "movie", None, "main")], "document_id string, title string, type string, season int, timeline_id string")
    got = knowledge.load(x.select("seq", "window_id", knowledge.read_extraction(F.col("raw")).alias("body")), documents, spark.createDataFrame([], "id string, parent string"))
    assert got["nodes"].count() == 5 and got["edges"].count() == 0 and got["ledger"].count() == 5 and seen.value == 5
