"""Behaviours that the query catalogue doesn't show."""

from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.operators import chunking, knowledge
from lantern.plans import planner
from lantern.plans.engine import Engine, status_line
from lantern.sources import releases, subtitles, tables
from lantern.streaming import ledger

SRT = "﻿1\n00:00:05,000 --> 00:00:07,500\nHello <i>there</i>\nfriend.\n\n2\n00:00:08,000 --> 00:00:09,000\n[DOOR SLAMS]\n\n3\n00:00:20,000 --> 00:00:22,250\n♪ la la ♪\n\n4\n00:00:23,000 --> 00:00:24,000\nBye.\n"


def test_parse_subtitles():
    cues = subtitles.parse(SRT)
    assert [c[0] for c in cues] == [1, 2, 3, 4]
    assert cues[0][1:] == (5.0, 7.5, "Hello <i>there</i> friend.")
    assert subtitles.parse("nothing here") == []


def test_decode():
    assert subtitles.decode("é".encode("cp1252")) == "é"
    assert subtitles.decode(b"\xff\xfe" + "é".encode("utf-16-le")) == "é"
    assert subtitles.decode(b"\xef\xbb\xbfa") == "a"


def test_read_clean_and_chunk(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT, encoding="utf-8")
    cues = subtitles.read_cues(spark, str(tmp_path)).withColumn("text", X.clean_cue(F.col("text"))).where("text <> ''")
    rows = chunking.scenes(cues, "path", ["cue"], F.col("start_s"), F.col("end_s")).orderBy("cue").collect()
    assert [(r["cue"], r["text"], r["scene"]) for r in rows] == [(1, "Hello there friend.", 0), (4, "Bye.", 1)]


def test_scene_gap_is_inclusive(spark):
    rows = spark.createDataFrame([("d", 1, 0.0, 1.0), ("d", 2, 5.0, 6.0), ("d", 3, 9.9, 11.0)], "d string, n int, s double, e double")
    assert [r["scene"] for r in chunking.scenes(rows, "d", ["n"], F.col("s"), F.col("e")).orderBy("n").collect()] == [0, 1, 1]


def test_ids(spark):
    row = spark.range(1).select(
        X.canonical_id(F.lit("character"), F.lit("The Winter Soldier!")).alias("a"), X.canonical_id(F.lit("object"), F.lit(" The ")).alias("b"), chunking.chunk_id(F.lit("doc:x"), F.lit(3), F.lit(17)).alias("c"), X.point_id(F.lit("x")).alias("d")
    ).first()
    assert row["a"] == "character:winter_soldier" and row["b"] == "object:the" and row["c"] == "doc:x#s0003c00017" and 0 < row["d"] < 2**60


def test_hedges(spark):
    said = ["It is unclear who won.", "He hid the evidence in the vault [1].", "Passage [1] mentions the vault; records.", "He won."]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = rows.select("i", X.is_hedge(F.col("s"), F.size(X.citations(F.col("s"))) > 0).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == [True, False, True, False]


def test_planner():
    assert planner.plan("Loki").operation == "find_entity"
    assert planner.plan("Who is Loki?").entities == ("Loki",)
    p = planner.coerce({"entities": [" a ", "", *"bcdefgh"], "intent": "nonsense", "operation": "next_events", "reference_event": "x" * 300})
    assert len(p.entities) == 6 and p.intent == "semantic" and p.operation == "next_events" and len(p.reference_event) == 160
    assert planner.coerce(None).operation == "free_search"


def test_engine_legs(spark):
    docs = spark.createDataFrame([(1, "the vault is open", "a"), (2, "the vault is shut", "b"), (3, "rain", "a")], "doc_id long, text string, scope string")
    vectors = spark.createDataFrame([(3, [1.0, 0.0])], "doc_id long, embedding array<double>")

    def broken(_):
        raise RuntimeError

    found = Engine(docs, vectors, broken).ask("what is in the vault")
    assert found.legs == {"lexical": "ok", "vector": "down"} and {e["key"] for e in found.evidence} == {1, 2}
    assert {e["key"] for e in Engine(docs).ask("what is in the vault", "b").evidence} == {2}
    assert Engine(docs, vectors, lambda _: [1.0, 0.0]).ask("qqq").legs == {"lexical": "empty", "vector": "ok"}
    assert status_line({"lexical": "ok", "vector": "down"}, {"lexical"}) == "DEGRADED: vector DOWN | lexical used"


def test_engine_asks_the_index_and_gates_its_answers(spark, tmp_path):
    from lantern.operators import index

    docs = spark.createDataFrame([(1, "the vault is open wide today", "a", "Vaults"), (2, "the vault is shut", "b", "Doors"), (3, "rain", "a", None)], "doc_id long, text string, scope string, title string")
    index.update(docs, f"{tmp_path}/i", "doc_id", scope=F.col("scope"))
    said = []

    def write(_, evidence):
        said.append(1)
        return "ANSWER: The moon is made of green cheese [1].\nUNCERTAINTY: none\nSOURCES: Nowhere" if len(said) == 1 else "ANSWER: The vault is open wide [1].\nUNCERTAINTY: none\nSOURCES: Nowhere; Vaults"

    engine = Engine(docs, answerer=write, index_path=f"{tmp_path}/i")
    found = engine.ask("what is in the open vault")
    assert {e["key"] for e in found.evidence} == {1, 2} and len(said) == 2 and found.note is None and found.sources == ["Vaults"]
    assert found.text.startswith("ANSWER: The vault is open") and found.used == {"lexical"}
    false = Engine(docs, answerer=lambda q, e: "Pigs fly over green mountains [1].", index_path=f"{tmp_path}/i").ask("vault", "b")
    assert false.note and {e["key"] for e in false.evidence} == {2} and false.sources == ["Doors"]


def test_gate(spark):
    good = '{"entities": [{"name": "Loki", "type": "Character", "aliases": []}], "relations": [{"source": "A b", "relation": "KNOWS", "target": "a B", "evidence_quote": "they know each other"}]}'
    bad = '{"entities": [{"name": "12", "type": "Character"}]}'
    rows = spark.createDataFrame([(0, good), (1, bad), (2, "not json"), (3, None)], "i int, j string")
    x = F.from_json("j", knowledge.EXTRACTION)
    got = rows.select("i", knowledge.gate(x).alias("ok"), F.size(knowledge.without_self_relations(x)).alias("n")).orderBy("i").collect()
    assert [r["ok"] for r in got][:2] == [True, False] and got[0]["n"] == 0


def test_release_ranking(spark):
    hits = spark.createDataFrame([(1, "Some.Show.S01E02.1080p.WEB-DL"), (2, "Some.Show.S01E03.1080p"), (3, "Other.S01E02")], "id int, r string")
    assert [r["id"] for r in releases.ranked(hits, "r", "Some Show", season=1, episode=2).collect()] == [1]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "d string, n int").write.partitionBy("d").parquet(path)
    tables.replace_partitions(spark.createDataFrame([("a", 5)], "d string, n int").select("n", "d"), path, "d")
    assert sorted((r["d"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2)]


def test_upsert_stream(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "key string, seq int, v string"
    assert ledger.upserted(spark, out, schema).collect() == []
    kept = {}
    batches = [[("k", 1, "x"), ("m", 1, "y"), (None, 1, "n")], [("k", 2, "z")], [("k", 1, "late"), ("p", 1, "q")], [("m", 1, "equal"), (None, 2, "o")]]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ledger.upsert_stream(stream, out, "key", "seq", str(tmp_path / "c"), buckets=64).awaitTermination()
        for k, n, v in rows:
            if n >= kept.get(k, (0, ""))[0]:
                kept[k] = (n, v)
        assert {r["key"]: (r["seq"], r["v"]) for r in ledger.upserted(spark, out, schema).collect()} == kept
    held = ledger._state(spark, out, number)
    assert len(set(held.values())) > 1  # untouched buckets stay where they are
    assert not (tmp_path / "out" / "state" / f"n={number - 2}").exists()
    import shutil

    shutil.rmtree(tmp_path / "out" / "state" / f"n={number}")  # a batch that died before its state was written
    (tmp_path / "c" / "commits" / str(number)).unlink()
    (tmp_path / "c" / "commits" / f".{number}.crc").unlink(missing_ok=True)
    ledger.upsert_stream(spark.readStream.schema(schema).parquet(source), out, "key", "seq", str(tmp_path / "c"), buckets=64).awaitTermination()
    assert {r["key"]: (r["seq"], r["v"]) for r in ledger.upserted(spark, out, schema).collect()} == kept
