"""Registered queries of the store, the loading of graphs, extraction, embedding, reranking and gold sets, with SQL for each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.catalog_queries import ORACLES, QUERIES, T, canonical_sql, query
from lantern.functions import text as X
from lantern.operators import chunking, evaluation, fusion, graph, knowledge, store, vector

__all__ = ["ORACLES", "QUERIES"]


def _string(c: str):
    return F.col(c).cast("string")


# -- chunks --------------------------------------------------------------------------------

@query("""WITH RECURSIVE c AS (SELECT 'conv:' || conv_id AS doc, turn, text, turn * 4.0 + (conv_id % 3) * (turn % 2) * 2.5 AS s, turn * 4.0 + (conv_id % 3) * (turn % 2) * 2.5 + 1.125 AS e FROM conversations WHERE text <> ''),
n AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY doc ORDER BY turn) >= 4.0 THEN 1 ELSE 0 END AS f FROM c),
t AS (SELECT *, length(text) AS n, regexp_matches(text, '[.!?]$') AS ends, row_number() OVER (PARTITION BY doc, scene ORDER BY turn) AS r FROM (SELECT *, sum(f) OVER (PARTITION BY doc ORDER BY turn) AS scene FROM n)),
p AS (SELECT doc, scene, turn, text, s, e, r, 0 AS g, n + 1 AS held FROM t WHERE r = 1
UNION ALL SELECT t.doc, t.scene, t.turn, t.text, t.s, t.e, t.r, p.g + CASE WHEN p.held + t.n + 1 > 1400 OR (t.ends AND p.held + t.n + 1 > 200) THEN 1 ELSE 0 END, CASE WHEN p.held + t.n + 1 > 1400 OR (t.ends AND p.held + t.n + 1 > 200) THEN t.n + 1 ELSE p.held + t.n + 1 END
FROM p JOIN t ON t.doc = p.doc AND t.scene = p.scene AND t.r = p.r + 1)
SELECT printf('%s#s%04dc%05d', doc, scene::INTEGER, min(turn)::INTEGER) AS chunk_id, doc AS document_id, scene::INTEGER AS scene_i, min(turn) AS cue_start, max(turn) AS cue_end,
trunc(min(s) * 1000)::INTEGER AS start_ms, trunc(max(e) * 1000)::INTEGER AS end_ms, trim(string_agg(text, ' ' ORDER BY turn)) AS text FROM p GROUP BY doc, scene, g""")
def chunk_records(spark, sf_dir):
    start = F.col("turn") * 4.0 + (F.col("conv_id") % 3) * (F.col("turn") % 2) * 2.5
    cues = T(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), _string("conv_id")).alias("doc"), "turn", "text", start.alias("s"), (start + 1.125).alias("e"))
    return chunking.chunk_records(cues, "doc", "turn", "text", "s", "e")


# -- store ---------------------------------------------------------------------------------

@query("""WITH n AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS slug, arg_max(o_orderstatus, o_orderkey) AS title, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey)
SELECT coalesce(c_custkey, id) AS document_id, coalesce(c_mktsegment, slug) AS slug, CASE WHEN id IS NULL THEN c_name ELSE title END AS title, CASE WHEN id IS NULL THEN c_acctbal ELSE value END AS value FROM customer FULL JOIN n ON c_custkey = id""")
def document_upsert(spark, sf_dir):
    held = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("slug"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("value"))
    last = lambda c: F.max_by(c, "o_orderkey")
    new = T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(last("o_orderpriority").alias("slug"), last("o_orderstatus").alias("title"), last("o_totalprice").alias("value"))
    return store.upsert_documents(held, new)


@query("""WITH n AS (SELECT conv_id, turn + 100 AS turn, text || '!' AS text FROM conversations WHERE role = 'user' AND length(text) > 100)
SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM n) UNION ALL SELECT * FROM n""")
def chunk_replace(spark, sf_dir):
    held = T(spark, sf_dir, "conversations")
    new = held.where("role = 'user' and length(text) > 100").select("conv_id", (F.col("turn") + 100).alias("turn"), F.concat("text", F.lit("!")).alias("text"))
    return store.replace_chunks(held.select("conv_id", "turn", "text"), new, "conv_id")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY lang, n_chars, doc_id")
def document_listing(spark, sf_dir):
    return store.listing(T(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang", "n_chars", "doc_id"])


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE starts_with(l_orderkey::VARCHAR, '12')")
def chunk_document_scan(spark, sf_dir):
    lines = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return store.scan_chunks(lines, T(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "12").withColumnRenamed("o_orderkey", "l_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT event_id FROM events)")
def point_lookups(spark, sf_dir):
    return store.lookup(T(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), T(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey")), "o_orderkey")


@query("SELECT conv_id, turn, epoch_us(ts) // 1000 / 1000 AS start_s, (epoch_us(ts) // 1000 + 1500) / 1000 AS end_s FROM conversations LEFT JOIN events ON event_id = conv_id")
def timecode_enrichment(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    chunks = T(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), ms.alias("start_ms"), (ms + 1500).alias("end_ms"))
    return store.with_times(T(spark, sf_dir, "conversations").select("conv_id", "turn"), chunks, "conv_id").select("conv_id", "turn", "start_s", "end_s")


@query("SELECT event_id FROM events WHERE NOT coalesce(event_type = 'click' AND value < 10, false)")
def purge_rows(spark, sf_dir):
    return store.without(T(spark, sf_dir, "events"), (F.col("event_type") == "click") & (F.col("value") < 10)).select("event_id")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark, sf_dir):
    return store.repeated(T(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query("SELECT doc_id, source FROM documents WHERE source LIKE 's%1%' ORDER BY doc_id LIMIT 1")
def fuzzy_slug(spark, sf_dir):
    return store.fuzzy_slug(T(spark, sf_dir, "documents").select("doc_id", "source"), "s_1_", "source", "doc_id")


@query("""
WITH e AS (SELECT p_partkey AS id, p_name AS title, p_size AS year, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'X' END AS type FROM part),
c AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE 'other' END AS found, l_quantity::INTEGER AS y, l_returnflag AS t FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT e.id, pos, found, title, CASE WHEN t = type AND y = year THEN 0 WHEN t = type THEN 1 WHEN abs(y - year) <= 1 THEN 2 END AS tier, abs(y - year) AS off FROM e JOIN c ON c.id = e.id)
SELECT id AS entry_id, pos, tier, tier = 0 OR lower(left(title, 12)) = lower(left(found, 12)) AS verified FROM r WHERE tier IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier = 2 THEN off ELSE 0 END, pos) = 1""")
def inventory_match(spark, sf_dir):
    part = T(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "N").otherwise("X")
    entries = part.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), kind.alias("type"))
    lines = T(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    title = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise("other")
    found = lines.select(F.col("l_partkey").alias("entry_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), title.alias("title"), F.col("l_quantity").cast("int").alias("year"), F.col("l_returnflag").alias("type"))
    return store.best_match(entries, found)


# -- graph loading -------------------------------------------------------------------------

def _events(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = T(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("scope"), (F.col("event_id") % 3000).alias("document_id"))
    return events, T(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), T(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


LOADED_SQL = "WITH e AS (SELECT event_id, user_id % 40 AS scope, event_id % 3000 AS document_id FROM events), s AS (SELECT n_nationkey AS id FROM nation), d AS (SELECT DISTINCT doc_id AS id FROM documents) "


@query(LOADED_SQL + "SELECT event_id AS src, 'OCCURS_IN' AS rel, scope AS dst FROM e WHERE scope IN (SELECT id FROM s) UNION SELECT event_id, 'DEPICTED_IN', document_id FROM e WHERE document_id IN (SELECT id FROM d)")
def event_scope_edges(spark, sf_dir):
    return knowledge.scoped_events(*_events(spark, sf_dir))[0]


@query(LOADED_SQL + "SELECT count(*) AS events, count(*) FILTER (scope IS NULL OR scope NOT IN (SELECT id FROM s)) AS no_scope, count(*) FILTER (document_id NOT IN (SELECT id FROM d)) AS no_document FROM e")
def event_missing_ends(spark, sf_dir):
    return knowledge.scoped_events(*_events(spark, sf_dir))[1]


@query("""SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'Movie' WHEN p_size < 30 THEN 'Episode' ELSE 'Series' END AS label, p_name AS name, p_partkey AS src, 'DEPICTED_IN' AS rel, p_partkey % 40 AS dst
FROM part WHERE p_partkey % 40 IN (SELECT n_nationkey FROM nation)""")
def document_nodes(spark, sf_dir):
    kind, season = F.when(F.col("p_size") < 10, "movie").otherwise("series"), F.when(F.col("p_size").between(10, 29), F.col("p_size"))
    docs = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("title"), kind.alias("type"), season.alias("season"), (F.col("p_partkey") % 40).alias("timeline_id"))
    return knowledge.document_nodes(docs, T(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")))


@query("SELECT n_name AS src, 'BRANCHES_FROM' AS rel, r_name AS dst FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 20")
def scope_branches(spark, sf_dir):
    region = T(spark, sf_dir, "region")
    parents = F.when(F.col("n_nationkey") < 20, F.col("r_name")).otherwise("elsewhere")
    nation = T(spark, sf_dir, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("id"), parents.alias("parent"))
    return knowledge.scope_branches(nation.union(region.select("r_name", F.lit(None).cast("string"))))


@query(f"""SELECT * FROM (SELECT {canonical_sql("'character'", "p_name")} AS src, CASE WHEN p_size < 25 THEN 'USES' ELSE 'KNOWS' END AS rel, {canonical_sql("'character'", "CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_type END")} AS dst FROM part) WHERE src <> dst""")
def relation_edges(spark, sf_dir):
    target = F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_type"))
    return knowledge.relation_edges(T(spark, sf_dir, "part").select(F.col("p_name").alias("source"), F.when(F.col("p_size") < 25, "USES").otherwise("KNOWS").alias("relation"), target.alias("target")))


@query("SELECT l_returnflag AS rel, count(*) AS written FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey FROM lineitem) GROUP BY ALL")
def written_counts(spark, sf_dir):
    return knowledge.written(T(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_partkey").alias("dst")).distinct())


@query("""SELECT e.event_id, to_json({'chunk_id': 'doc:' || user_id || '#w0001', 'document_id': 'doc:' || user_id, 'source': d.source, 'source_type': 'movie', 'timeline_id': d.lang})::VARCHAR AS provenance
FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id""")
def provenance_json(spark, sf_dir):
    doc = F.concat(F.lit("doc:"), _string("user_id"))
    made = knowledge.provenance(chunking.window_id(doc, F.lit(1)), doc, F.col("source"), F.lit("movie"), F.col("lang"))
    events = T(spark, sf_dir, "events").join(T(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), "source", "lang"), "user_id", "left")
    return events.select("event_id", made.alias("provenance"))


# The reference's rules for what is read, in SQL: names of an event and of its pairs are registered in the order of windows.
LOADED_SQL = """WITH x AS (SELECT event_id, user_id, event_type AS name, (json_extract_string(props, '$.k'))::INTEGER AS k FROM events JOIN documents ON doc_id = user_id),
g AS (SELECT *, {'chunk_id': user_id || '#w' || event_id, 'document_id': user_id::VARCHAR, 'source': d.source, 'source_type': 'movie', 'timeline_id': d.lang} AS p FROM x JOIN documents d ON d.doc_id = user_id WHERE k <> 7)
"""


@query(LOADED_SQL + """, r AS (SELECT event_id, 'object:' || name AS id, name, 'Object' AS label, p FROM g UNION ALL SELECT event_id, 'character:person_' || k, 'person ' || k, 'Character', p FROM g
UNION ALL SELECT event_id, 'event:meeting_' || k, 'Meeting ' || k, 'Event', p FROM g UNION ALL SELECT event_id, 'event:meeting_' || (k + 1), 'Meeting ' || (k + 1), 'Event', p FROM g)
SELECT id, name, label, to_json(arg_max(p, event_id))::VARCHAR AS provenance FROM r GROUP BY id, name, label""")
def load_extractions(spark, sf_dir):
    return _loaded(spark, sf_dir)["nodes"].select("id", "name", "label", "provenance")


@query(LOADED_SQL + """, r AS (SELECT event_id, 'character:person_' || k AS src, 'PARTICIPATES_IN' AS rel, 'event:meeting_' || k AS dst, p FROM g UNION ALL SELECT event_id, 'event:meeting_' || k, 'BEFORE', 'event:meeting_' || (k + 1), p FROM g)
SELECT src, rel, dst, to_json(arg_min(p, event_id))::VARCHAR AS provenance FROM r GROUP BY src, rel, dst
UNION ALL SELECT DISTINCT 'event:meeting_' || k, 'OCCURS_IN', 'timeline:' || (p).timeline_id, NULL FROM g WHERE (p).timeline_id IN ('en', 'fr') UNION ALL SELECT DISTINCT 'event:meeting_' || k, 'DEPICTED_IN', (p).document_id, NULL FROM g""")
def load_extraction_edges(spark, sf_dir):
    return _loaded(spark, sf_dir)["edges"]


@query(LOADED_SQL + "SELECT (SELECT count(*) FROM x) AS windows, count(*) AS chunks, count(*) AS entities, count(*) AS events, 0::BIGINT AS relations, count(*) AS temporals, (SELECT count(*) FROM events) - count(*) AS skipped FROM g")
def load_totals(spark, sf_dir):
    """Counted by the pass that writes the gated windows."""
    totals = _loaded(spark, sf_dir)["totals"]
    known = T(spark, sf_dir, "events").join(T(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id")), "user_id", "left_semi").agg(F.count("*").alias("windows"))
    return known.select("windows", *(F.lit(int(v)).cast("long").alias(k) for k, v in totals.items()))


def _loaded(spark, sf_dir) -> dict:
    documents = T(spark, sf_dir, "documents").select(_string("doc_id").alias("document_id"), F.col("source").alias("title"), F.lit("movie").alias("type"), F.lit(None).cast("int").alias("season"), F.col("lang").alias("timeline_id"))
    scopes = spark.createDataFrame([("timeline:en", None), ("timeline:fr", "timeline:en")], "id string, parent string")
    return knowledge.load(_extractions(spark, sf_dir), documents, scopes)


def _extractions(spark, sf_dir) -> DataFrame:
    """A window for each event: an object, a person at a numbered meeting, and the meeting after it. Those of k = 7 are invalid."""
    k = F.from_json("props", "k int")["k"]
    none, quote = F.array().cast("array<string>"), F.lit("a quoted line")
    entity = F.struct(F.col("event_type").alias("name"), F.when(k == 7, "Nothing").otherwise("Object").alias("type"), none.alias("aliases"))
    meeting = lambda n: F.concat(F.lit("Meeting "), n.cast("string"))
    event = F.struct(meeting(k).alias("name"), F.array(F.concat(F.lit("person "), k.cast("string"))).alias("participants"), none.alias("objects"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("date"), F.lit("year").alias("date_precision"), quote.alias("evidence_quote"))
    after = F.struct(meeting(k + 1).alias("event_a"), meeting(k).alias("event_b"), F.lit("AFTER").alias("relation"), quote.alias("evidence_quote"))
    raw = F.to_json(F.struct(F.array(entity).alias("entities"), F.array(event).alias("events"), F.array(after).alias("temporals")))
    window = F.concat(_string("user_id"), F.lit("#w"), _string("event_id"))
    return T(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), window.alias("window_id"), F.from_json(raw, knowledge.EXTRACTION).alias("body"))


# -- registry and extraction ---------------------------------------------------------------

@query(f"SELECT DISTINCT {canonical_sql(chr(39) + 'object' + chr(39), 'p_name')} AS entity_id, p_name AS name FROM part WHERE NOT regexp_matches(p_name, '[^\\x00-\\x7F]')")
def seed_entities(spark, sf_dir):
    rows = T(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("Object").alias("kind"), F.array("p_brand").alias("aliases")).union(spark.createDataFrame([("Ölwanne", "Object", [])], "name string, kind string, aliases array<string>"))
    return knowledge.seeds(rows).select("entity_id", "name").distinct()


@query(f"""WITH n AS (SELECT n_nationkey AS seq, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT {canonical_sql("'location'", "arg_min(name, seq)")} AS entity_id, arg_min(name, seq) AS name, list_sort(list_append(list(name) FILTER (seq > low), region)) AS aliases
FROM (SELECT *, min(seq) OVER (PARTITION BY region) AS low FROM n) GROUP BY region""")
def registry_alias_merge(spark, sf_dir):
    region = T(spark, sf_dir, "region")
    rows = T(spark, sf_dir, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    mentions = rows.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("name"), F.lit("Location").alias("kind"), F.array("r_name").alias("aliases"))
    return knowledge.merge_by_alias(mentions).select("entity_id", "name", F.array_sort("aliases").alias("aliases"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click' AND value >= 50)")
def extraction_cache_todo(spark, sf_dir):
    body = F.when(F.col("value") >= 50, F.lit('{"entities": []}')).otherwise("{not json")
    cache = T(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), F.when(F.col("event_type") == "click", "ok").otherwise("fail").alias("status"), body.alias("body"))
    return knowledge.to_extract(T(spark, sf_dir, "conversations").select("conv_id", "turn"), cache, ["conv_id"])


def _extractor(text: str) -> str:
    """A stand-in for a model: what it says depends on the text's length."""
    if len(text) % 4 == 0:
        raise ValueError("busy")
    return ["[]", json.dumps({"entities": [{"name": "x", "type": "Object"}]}), json.dumps({"entities": [{"name": "a thing", "type": "Object"}]})][len(text) % 4 - 1]


@query("SELECT CASE length(text) % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'not_dict' WHEN 2 THEN 'invalid' ELSE 'ok' END AS status, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def extraction_run_totals(spark, sf_dir):
    windows = T(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("window_id"), "text")
    return knowledge.run_totals(knowledge.run_extraction(windows, _extractor))


# -- embedding and reranking ---------------------------------------------------------------

def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedder: counts of letters."""
    return [[float(t.lower().count(chr(c))) for c in range(97, 123)] for t in texts]


@query("""WITH c AS (SELECT conv_id, turn, list_transform(range(97, 123), lambda c: (length(t) - length(replace(t, chr(c::INTEGER), '')))::DOUBLE) AS v FROM (SELECT conv_id, turn, lower('passage: ' || left(coalesce(text, ''), 2048)) AS t FROM conversations))
SELECT conv_id, turn, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 9)) AS embedding FROM c""")
def embed_passages(spark, sf_dir):
    rows = vector.embed(T(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", _letters)
    return rows.select("conv_id", "turn", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT event_id FROM events) UNION ALL SELECT event_id, -1 FROM events")
def vector_upsert(spark, sf_dir):
    new = T(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.lit(-1).alias("label"))
    return vector.upsert_points(T(spark, sf_dir, "embeddings").select("vec_id", "label"), new, "vec_id")


@query("""WITH p AS (SELECT doc_id, lang, n_chars, (length(text) % 7 - 3)::DOUBLE AS raw, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS p FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, max(CASE WHEN raw < 0 OR raw > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS outside FROM p WHERE p <= 24)
SELECT doc_id, round(CASE WHEN outside = 1 THEN 1 / (1 + exp(-raw)) ELSE raw END, 9) AS score FROM h UNION ALL SELECT doc_id, n_chars::DOUBLE FROM p WHERE p > 24""")
def rerank_pool(spark, sf_dir):
    docs = T(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("key"), "lang", "text", F.col("n_chars").cast("double").alias("score"))
    scored = fusion.rescore(docs, lambda q, t: [float(len(x) % 7 - 3) for x in t], "lang", "text")
    return scored.select(F.col("key").alias("doc_id"), F.round("score", 9).alias("score"))


@query("""WITH e AS (SELECT conv_id, turn + 1 AS slot, role AS leg FROM conversations), c AS (SELECT DISTINCT conv_id, turn + 1 AS slot FROM conversations WHERE length(text) % 3 = 0),
s AS (SELECT * FROM e WHERE slot <= 6), h AS (SELECT s.* FROM s JOIN c USING (conv_id, slot))
SELECT DISTINCT conv_id, leg FROM (SELECT * FROM h UNION ALL SELECT * FROM s WHERE conv_id NOT IN (SELECT conv_id FROM h))""")
def used_legs(spark, sf_dir):
    turns = T(spark, sf_dir, "conversations").withColumn("slot", F.col("turn") + 1)
    return fusion.used_legs(turns.select("conv_id", "slot", F.col("role").alias("leg")), turns.where("length(text) % 3 = 0").select("conv_id", "slot"), "conv_id")


@query("""SELECT p_partkey, arg_max(w, length(w) * 1000 - i) AS longest FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part) GROUP BY p_partkey""")
def longest_token(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", fusion.longest(F.split("p_name", " ")).alias("longest"))


NEIGHBOURS_SQL = """WITH u AS (SELECT n_name AS id, 'IN' AS rel, r_name AS other FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, 'IN', n_name FROM nation JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other, rel) AS r FROM u)
SELECT id, id || ' (Place): ' || string_agg(other, ', ' ORDER BY r) AS quote FROM k WHERE r <= 4 GROUP BY id"""


@query(NEIGHBOURS_SQL)
def graph_evidence(spark, sf_dir):
    edges = T(spark, sf_dir, "nation").join(T(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("src"), F.lit("IN").alias("rel"), F.col("r_name").alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return graph.neighbours(nodes, edges).select("id", fusion.graph_quote(F.col("id"), F.lit("Place"), F.col("neighbours")).alias("quote"))


# -- gold sets and evaluation --------------------------------------------------------------

@query("""WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS s FROM events), f AS (SELECT user_id, arg_min(event_id, event_id) AS e, arg_min(s, event_id) AS s FROM t GROUP BY user_id),
n AS (SELECT f.user_id, f.e, min(t.event_id) FILTER (abs(t.s - f.s) > 86400) AS b FROM f JOIN t ON t.user_id = f.user_id GROUP BY ALL)
SELECT user_id, CASE WHEN b IS NULL THEN [e] ELSE [e, b] END AS picked FROM n""")
def spaced_pick(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return evaluation.spaced(T(spark, sf_dir, "events").select("user_id", "event_id", seconds.alias("s")), "user_id", "event_id", "s", apart=86400.0)


@query("""SELECT doc_id FROM (SELECT doc_id, length(text) AS n, count(*) FILTER (length(text) BETWEEN 150 AND 800) OVER (PARTITION BY source) AS k FROM documents) WHERE CASE WHEN k >= 2 THEN n BETWEEN 150 AND 800 ELSE n >= 80 END""")
def length_fallback(spark, sf_dir):
    return evaluation.of_length(T(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text").select("doc_id")


@query(r"""SELECT min(conv_id * 1000 + turn) AS id FROM conversations GROUP BY lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}]+', '', 'g'))""")
def question_dedup(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return evaluation.distinct_questions(rows, "text", "id").select("id")


@query("""WITH r AS (SELECT user_id, event_type AS leg, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rank FROM events)
SELECT leg, round(sum(h) / (SELECT count(DISTINCT user_id) FROM events), 4) AS recall FROM (SELECT leg, user_id, max(CASE WHEN rank <= 6 AND value >= 90 THEN 1 ELSE 0 END) AS h FROM r GROUP BY ALL) GROUP BY leg""")
def leg_recall(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = T(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("leg"), rank.alias("rank"), F.when(F.col("value") >= 90, 1).otherwise(0).alias("grade"))
    return evaluation.leg_recall(rows)


@query("""WITH c AS (SELECT user_id AS case_id, arg_min(event_type, event_id) AS d, CASE WHEN user_id % 5 > 0 THEN min(epoch_us(ts)) / 1000000.0 END AS s FROM events GROUP BY user_id),
r AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS rank, event_type AS d, epoch_us(ts) / 1000000.0 AS s FROM events)
SELECT r.case_id, rank, CASE WHEN r.d IS DISTINCT FROM c.d THEN 0 WHEN c.s IS NULL OR r.s IS NULL THEN 1 WHEN r.s <= c.s + 1000 AND c.s <= r.s + 60 THEN 3 WHEN r.s <= c.s + 1000 + 500000 AND c.s - 500000 <= r.s + 60 THEN 2 ELSE 1 END AS grade FROM r JOIN c USING (case_id)""")
def graded_run(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = T(spark, sf_dir, "events").withColumn("s", seconds)
    first = events.groupBy(F.col("user_id").alias("case_id")).agg(F.min_by("event_type", "event_id").alias("document_id"), F.min("s").alias("s"))
    start = F.when(F.col("case_id") % 5 > 0, F.col("s"))
    cases = first.select("case_id", "document_id", start.alias("start"), (start + 1000).alias("end"), F.lit(500000).alias("pad"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return evaluation.run_cases(cases, events.select(F.col("user_id").alias("case_id"), rank.alias("rank"), F.col("event_type").alias("document_id"), F.col("s").alias("start"), (F.col("s") + 60).alias("end")))


@query(r"""WITH a AS (SELECT conv_id, turn, role, text || ' [' || (turn % 3 + 1) || ']' AS answer FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, regexp_matches(lower(answer), '\b' || role || '\b') AS names_entity, true AS cites,
  len(list_filter(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: NOT coalesce(TRY_CAST(x AS INTEGER) BETWEEN 1 AND 2, false))) = 0 AS cites_in_range FROM a""")
def answer_checks(spark, sf_dir):
    turns = T(spark, sf_dir, "conversations").where("text is not null")
    rows = turns.select("conv_id", "turn", F.col("role").alias("entity"), F.concat("text", F.lit(" ["), (F.col("turn") % 3 + 1).cast("string"), F.lit("]")).alias("answer"), F.lit(2).alias("n_slots"))
    return evaluation.answer_checks(rows).select("conv_id", "turn", "names_entity", "cites", "cites_in_range")


@query("SELECT doc_id FROM documents WHERE coalesce(n_chars, 0) >= 3000")
def least_count_filter(spark, sf_dir):
    return T(spark, sf_dir, "documents").where(F.coalesce("n_chars", F.lit(0)) >= 3000).select("doc_id")


@query("SELECT page_id, lower(left(regexp_replace(url, '[^A-Za-z0-9]+', ' ', 'g'), 120)) AS name FROM pages WHERE url IS NOT NULL")
def left_slices(spark, sf_dir):
    return T(spark, sf_dir, "pages").where("url is not null").select("page_id", F.lower(F.left(F.regexp_replace("url", "[^A-Za-z0-9]+", " "), F.lit(120))).alias("name"))


@query(f"SELECT doc_id, {' OR '.join(f'contains(lower(text), {h!r})' for h in X.META)} AS meta FROM documents")
def meta_words(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", X.any_of(F.lower("text"), X.META).alias("meta"))
