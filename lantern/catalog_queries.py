"""Registered queries of the engine's own operators, with SQL for each.

The test tables stand in for the engine's own: documents are the corpus (lang is the scope),
embeddings the vector collection (label is the scope; vec_id pairs with doc_id), conversations and
events ordered cues, pages the scraped source, benchmark the golden questions, and the
customer-order tables a property graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.functions import text as X
from lantern.operators import chunking, evaluation, fusion, graph, grounding, incremental, index, knowledge, lexical, vector
from lantern.operators.names import lookup
from lantern.plans.lineage import scratch
from lantern.sources import releases, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T = tables.read


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- lexical -------------------------------------------------------------------------------

WORDS = ["license", "rights reserved", "gnu general public license", "scum", "worthless"]
SINGLE = ["license", "scum", "worthless", "version"]


#: The index's terms in SQL: case and accents folded, split at all that isn't a letter or number.
TERMS_SQL = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+')"


def bm25_sql(phrases: list[str], after: str) -> str:
    split = [lexical.phrases_of([p])[0] for p in phrases]
    counts = ", ".join(
        "len(list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{t}'" for k, t in enumerate(p)) + f")) AS f{j}" for j, p in enumerate(split)
    )
    dfs = ", ".join(f"count(*) FILTER (f{j} > 0) AS n{j}" for j in range(len(split)))
    score = " + ".join(
        f"(CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{j} + 0.5) / (n{j} + 0.5)) END) * (f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * dl / a)))" for j in range(len(split))
    )
    some = " OR ".join(f"f{j} > 0" for j in range(len(split)))
    return f"""
WITH t AS (SELECT doc_id, lang, {TERMS_SQL} AS w FROM documents),
c AS (SELECT doc_id, lang, len(w) AS dl, {counts} FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a, {dfs} FROM c),
hits AS (SELECT doc_id, lang, round({score}, 6) AS bm25 FROM c, s WHERE {some})
{after}"""


def _top(found: DataFrame, k: int = 20) -> DataFrame:
    return found.withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), "doc_id").limit(k)


@query(bm25_sql(SINGLE, "SELECT doc_id, bm25 FROM hits ORDER BY bm25 DESC, doc_id LIMIT 20"))
def bm25_topk(spark, sf_dir):
    return _top(lexical.bm25(T(spark, sf_dir, "documents").select("doc_id", "text"), SINGLE))


@query(bm25_sql(WORDS, "SELECT doc_id, bm25 FROM hits ORDER BY bm25 DESC, doc_id LIMIT 20"))
def bm25_phrase_or(spark, sf_dir):
    return _top(lexical.bm25(T(spark, sf_dir, "documents").select("doc_id", "text"), WORDS))


@query(bm25_sql(WORDS, "SELECT h.doc_id, bm25, l.quality FROM (SELECT * FROM hits WHERE lang = 'en' ORDER BY bm25 DESC, doc_id LIMIT 20) h LEFT JOIN labels l ON l.doc_id = h.doc_id"))
def bm25_scoped_topk(spark, sf_dir):
    found = index.search(spark, corpus_index(spark, sf_dir), WORDS, 20, "en", 6)
    best = _top(found.select(F.col("id").alias("doc_id"), "bm25"))
    return T(spark, sf_dir, "labels").select("doc_id", "quality").join(F.broadcast(best), "doc_id", "right").select("doc_id", "bm25", "quality")


@query(bm25_sql(WORDS, "SELECT doc_id, bm25 FROM hits"))
def bm25_index_search(spark, sf_dir):
    found = index.search(spark, corpus_index(spark, sf_dir), WORDS)
    return found.select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {TERMS_SQL} AS w FROM documents) WHERE list_contains(w, 'and') AND list_contains(w, 'license') AND list_contains(w, 'the')")
def boolean_and_search(spark, sf_dir):
    return lexical.boolean_and(T(spark, sf_dir, "documents").select("doc_id", "text"), 'and "license" the').select("doc_id")


@query(f"""SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(range(len(w)), lambda i: w[i + 1] = 'public' AND w[i + 2] = 'license'))::INTEGER AS n
FROM (SELECT doc_id, {TERMS_SQL} AS w FROM documents)) WHERE n > 0""")
def phrase_search(spark, sf_dir):
    found = lexical.frequencies(T(spark, sf_dir, "documents").select("doc_id", "text"), "text", [["public", "license"]])
    return found.select("doc_id", F.col("tf")[0].alias("n")).where("n > 0")


@query(f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY ALL) GROUP BY term""")
def doc_stats_postings(spark, sf_dir):
    return lexical.term_statistics(T(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(f"""SELECT DISTINCT lang, token FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9''-]+')) AS token FROM documents)
WHERE len(token) > 2 AND NOT list_contains({X.STOP_WORDS!r}, token)""")
def content_token_vocabulary(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("lang", F.explode(X.content_tokens(F.col("text"))).alias("token")).distinct()


# -- vectors -------------------------------------------------------------------------------

NEAR_SQL = """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q.e), 6) AS score FROM embeddings, q {where}
ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q.e) DESC, vec_id LIMIT 10"""


def _query_vector(spark, sf_dir) -> list[float]:
    return T(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(NEAR_SQL.format(where=""))
def cosine_topk(spark, sf_dir):
    return vector.top_k(T(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


@query(NEAR_SQL.format(where="WHERE label = 3"))
def cosine_topk_scoped(spark, sf_dir):
    return vector.top_k(T(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), scope=F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


@query("""SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) DESC, b.vec_id)::INTEGER AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5""")
def cosine_batch_topk(spark, sf_dir):
    e = T(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector.batch_top_k(e, e.where("vec_id % 50 = 0"), 5).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, ('0x' || substr(sha256('doc:' || doc_id::VARCHAR), 1, 15))::BIGINT AS point_id FROM documents")
def vector_point_ids(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", X.point_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


# -- fusion --------------------------------------------------------------------------------

LEGS = ["and", "version", "license", "scum", "loser"]
LEGS_SQL = bm25_sql(
    LEGS,
    """, l AS (SELECT doc_id, bm25 FROM hits ORDER BY bm25 DESC, doc_id LIMIT 20),
q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q.e), 6) AS cosine FROM embeddings, q ORDER BY cosine DESC, doc_id LIMIT 10),
ls AS (SELECT doc_id, CASE WHEN {by_rank} OR max(bm25) OVER () = min(bm25) OVER ()
  THEN (count(*) OVER () - row_number() OVER (ORDER BY bm25 DESC, doc_id) + 1)::DOUBLE / count(*) OVER ()
  ELSE (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS s FROM l),
f AS (SELECT coalesce(ls.doc_id, v.doc_id) AS doc_id, round(0.3 * coalesce(cosine, 0) + 0.7 * coalesce(s, 0), 5) AS score,
  concat_ws('+', CASE WHEN cosine IS NOT NULL THEN 'vector' END, CASE WHEN s IS NOT NULL THEN 'fts' END) AS legs FROM ls FULL JOIN v ON ls.doc_id = v.doc_id)
""",
)


_INDEXES: dict[tuple[str, str], str] = {}


def corpus_index(spark, sf_dir) -> str:
    """The index of all documents, made by the first question of a session that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = scratch(spark, "index")
        index.update(T(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "doc_id", scope=F.col("lang"))
        _INDEXES[key] = path
    return _INDEXES[key]


def _legs(spark, sf_dir, by_rank: bool = False) -> DataFrame:
    hits = index.search(spark, corpus_index(spark, sf_dir), LEGS, 20, digits=6).withColumnRenamed("id", "doc_id")
    near = vector.top_k(T(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("cosine"))
    return fusion.blend(_top(hits), near, "doc_id", by_rank=by_rank).withColumn("score", F.round("score", 5))


@query(LEGS_SQL.replace("{by_rank}", "false") + "SELECT doc_id, score FROM f")
def fusion_weighted(spark, sf_dir):
    return _legs(spark, sf_dir).select("doc_id", "score")


@query(LEGS_SQL.replace("{by_rank}", "true") + "SELECT doc_id, score FROM f")
def fusion_rank_decay(spark, sf_dir):
    return _legs(spark, sf_dir, True).select("doc_id", "score")


@query(LEGS_SQL.replace("{by_rank}", "false") + "SELECT legs, count(*) AS n FROM f GROUP BY legs")
def fusion_leg_attribution(spark, sf_dir):
    return _legs(spark, sf_dir).groupBy("legs").agg(F.count("*").alias("n"))


MERGE_SQL = """, g AS (SELECT 'event:' || event_id AS key, 'entity' AS type, CASE WHEN event_type = 'click' THEN 0.62 ELSE 0.55 END AS score FROM events
  UNION ALL SELECT 'path:' || n_nationkey, 'path', 0.95 FROM nation),
u AS (SELECT 'doc:' || doc_id AS key, 'chunk' AS type, score FROM f UNION ALL SELECT * FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, key) AS p FROM u)
SELECT key, type, score FROM (SELECT key, type, score FROM r WHERE p <= CASE type WHEN 'path' THEN 2 WHEN 'entity' THEN 3 ELSE 1000000 END
  ORDER BY score DESC, CASE type WHEN 'chunk' THEN 1 ELSE 0 END, key LIMIT 20)"""


@query(LEGS_SQL.replace("{by_rank}", "false") + MERGE_SQL)
def rerank_caps_topn(spark, sf_dir):
    chunks = _legs(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.lit("chunk").alias("type"), "score")
    events = T(spark, sf_dir, "events")
    rows = events.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("key"), F.lit("entity").alias("type"), fusion.graph_score(F.lit("entity"), F.col("event_type") == "click").alias("score"))
    paths = T(spark, sf_dir, "nation").select(F.concat(F.lit("path:"), F.col("n_nationkey").cast("string")), F.lit("path"), fusion.graph_score(F.lit("path"), F.lit(False)))
    return fusion.merge(chunks.union(rows).union(paths)).select("key", "type", "score")


@query(LEGS_SQL.replace("{by_rank}", "false") + """SELECT row_number() OVER (ORDER BY score DESC, key)::INTEGER AS slot, key, left(text, 600) AS quote
FROM (SELECT f.doc_id AS key, score, text FROM f JOIN documents d ON d.doc_id = f.doc_id) QUALIFY slot <= 6""")
def evidence_slots(spark, sf_dir):
    ranked = _legs(spark, sf_dir)
    docs = T(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(ranked), "doc_id")
    return fusion.evidence(docs.select(F.col("doc_id").alias("key"), "text", "score"))


@query("""SELECT event_id, round(CASE WHEN max(CASE WHEN value < 0 OR value > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1
  THEN 1 / (1 + exp(-value)) ELSE value END, 9) AS rerank FROM events""")
def rerank_sigmoid(spark, sf_dir):
    return fusion.rerank_scores(T(spark, sf_dir, "events"), "user_id", "value").select("event_id", F.round("rerank", 9).alias("rerank"))


# -- cleaning and guards -------------------------------------------------------------------

CLEAN_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\{[^}]+\}', '', 'g'), '^#[\p{L}\p{N}_]+#', ''), '-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\v\x{85}\p{Z}]+|[\s\v\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^♪.*♪$|^#[\p{L}\p{M}\p{N}\p{Pc}]+$|^\[[^\]]{0,40}\]$|^\([^)]{0,40}\)$')) AS l FROM a)
SELECT page_id, trim(regexp_replace(array_to_string(l, ' '), '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS clean FROM b"""


@query(CLEAN_SQL)
def clean_text(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", X.clean_cue(F.col("html")).alias("clean"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^♪.*♪$|^#[\p{L}\p{M}\p{N}\p{Pc}]+$|^\[[^\]]{0,40}\]$|^\([^)]{0,40}\)$')))::INTEGER AS noise,
len(string_split(text, chr(10)))::INTEGER AS lines FROM documents""")
def noise_filter(spark, sf_dir):
    lines = F.split("text", "\n")
    return T(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, X.is_noise)).alias("noise"), F.size(lines).alias("lines"))


@query(r"""SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:40] AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM pages)""")
def html_link_extract(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", releases.links(F.col("html"), r'href="(/[^"]*)"').alias("links"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\v]+', ' ', 'g')) AS body FROM pages""")
def html_strip(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")).alias("body"))


@query("SELECT page_id, contains(lower(left(html, 400)), '<html') AS is_html FROM pages")
def html_guard(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", X.looks_like_html(F.col("html")).alias("is_html"))


@query(r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}]', '', 'g')) AS word,
length(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}]|[\x00-\x7F]', '', 'g')) AS other, length(text) - length(replace(text, '�', '')) AS broken FROM documents)
SELECT doc_id, word > 0 AND latin >= 20 AND other < 0.15 * word AND broken < 10 AS latin_text FROM c""")
def latin_ratio_gate(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", X.mostly_latin(F.col("text")).alias("latin_text"))


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{m}')" for m in X.SPAM) + " AS spam FROM documents")
def spam_guard(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", X.has_spam(F.col("text")).alias("spam"))


# -- scenes, chunks, windows ---------------------------------------------------------------

@query("""SELECT event_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS scene FROM (
SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 14400000000 THEN 1 ELSE 0 END AS n FROM events)""")
def scene_segmentation(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return chunking.scenes(T(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], seconds, seconds, 14400.0).select("event_id", "scene")


PACK_SQL = """WITH RECURSIVE t AS (SELECT conv_id, turn, text, length(text) AS n, regexp_matches(text, '[.!?]$') AS ends, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, text, r, 0 AS g, {first} AS held FROM t WHERE r = 1
UNION ALL SELECT t.conv_id, t.turn, t.text, t.r, f.g + CASE WHEN {flush} THEN 1 ELSE 0 END, CASE WHEN {flush} THEN {first} ELSE {more} END
FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
"""


@query(PACK_SQL.format(first="t.n + 1", flush="f.held + t.n + 1 > 1400 OR (t.ends AND f.held + t.n + 1 > 200)", more="f.held + t.n + 1").replace("t.n + 1 AS held", "n + 1 AS held")
       + """SELECT conv_id, g::INTEGER AS "group", min(turn) AS first, max(turn) AS last, count(*) AS n, trim(array_to_string(list_filter(list(text ORDER BY turn), lambda x: x <> ''), ' ')) AS text FROM f GROUP BY conv_id, g""")
def chunk_packing(spark, sf_dir):
    return chunking.chunks(T(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(PACK_SQL.format(first="t.n", flush="f.held + t.n > 2200", more="f.held + t.n + 1").replace("t.n AS held", "n AS held")
       + "SELECT printf('conv:%d#w%04d', conv_id, g::INTEGER) AS window_id, count(*) AS members, sum(length(text))::BIGINT AS chars FROM f GROUP BY conv_id, g")
def extraction_windows(spark, sf_dir):
    packed = chunking.pack(T(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", chunking.WINDOW_MAX)
    name = chunking.window_id(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")), F.col("group"))
    return packed.groupBy("conv_id", "group").agg(F.count("*").alias("members"), F.sum(F.length("text")).alias("chars")).select(name.alias("window_id"), "members", "chars")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS ordinal FROM conversations")
def turn_ordinals(spark, sf_dir):
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("ordinal"))


# -- knowledge graph -----------------------------------------------------------------------

def canonical_sql(kind: str, name: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({name}), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x NOT IN ('', 'the', 'a', 'an', 'of'))"
    return f"CASE WHEN len({words}) > 0 THEN {kind} || ':' || array_to_string({words}, '_') ELSE {kind} || ':' || trim(lower({name})) END"


@query(f"SELECT p_partkey, {canonical_sql(chr(39) + 'object' + chr(39), 'p_name')} AS entity_id FROM part")
def canonical_ids(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", X.canonical_id(F.lit("object"), F.col("p_name")).alias("entity_id"))


ALIASES_SQL = """aliases AS (SELECT p_brand AS alias, 'object:' || p_partkey AS entity_id, 'Object' AS kind, p_partkey AS position FROM part
UNION ALL SELECT p_brand, 'organization:' || p_partkey, 'Organization', p_partkey + 1000000000 FROM part WHERE p_size >= 20)"""


def _aliases(spark, sf_dir) -> DataFrame:
    part = T(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    objects = part.select(F.col("p_brand").alias("alias"), F.concat(F.lit("object:"), key).alias("entity_id"), F.lit("Object").alias("kind"), F.col("p_partkey").alias("position"))
    return objects.union(part.where("p_size >= 20").select("p_brand", F.concat(F.lit("organization:"), key), F.lit("Organization"), F.col("p_partkey") + 1_000_000_000))


def resolve_sql(kind: str) -> str:
    return f"""WITH {ALIASES_SQL}, m AS (SELECT p_partkey, p_brand AS name, '{kind}' AS kind FROM part),
c AS (SELECT m.p_partkey, a.entity_id, row_number() OVER (PARTITION BY m.p_partkey ORDER BY CASE WHEN a.kind = m.kind THEN 0 ELSE 1 END, a.position) AS r
FROM m JOIN aliases a ON lower(trim(a.alias)) = lower(trim(m.name)))
SELECT m.p_partkey, coalesce(c.entity_id, {canonical_sql("lower(m.kind)", "m.name")}) AS entity_id FROM m LEFT JOIN c ON c.p_partkey = m.p_partkey AND c.r = 1"""


@query(resolve_sql("Object"))
def alias_resolve(spark, sf_dir):
    mentions = T(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), F.lit("Object").alias("kind"))
    return knowledge.resolve(mentions, _aliases(spark, sf_dir)).select("p_partkey", "entity_id")


@query(resolve_sql("Organization"))
def alias_type_disambiguation(spark, sf_dir):
    mentions = T(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), F.lit("Organization").alias("kind"))
    return knowledge.resolve(mentions, _aliases(spark, sf_dir)).select("p_partkey", "entity_id")


@query(f"""SELECT entity_id, arg_min(name, seq) AS name, list_sort(list(DISTINCT alias)) AS aliases FROM (
SELECT p_partkey AS seq, p_type AS name, p_brand AS alias, {canonical_sql("'object'", "p_type")} AS entity_id FROM part) GROUP BY entity_id""")
def entity_register_merge(spark, sf_dir):
    mentions = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("name"), F.lit("Object").alias("kind"), F.array("p_brand").alias("alias"))
    return knowledge.register(mentions)


@query("""WITH r AS (SELECT o_orderkey AS seq, o_custkey AS id, o_orderstatus AS name, string_split(o_orderpriority, ' ') AS aliases FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT id, arg_min(name, seq) AS name, arg_max(aliases, len(aliases) * 1000000000000 - seq) AS aliases, max(seq) AS provenance FROM r GROUP BY id""")
def node_upsert_latest(spark, sf_dir):
    label = F.when(F.col("o_orderstatus") == "F", "Object").when(F.col("o_orderstatus") == "O", "Character").otherwise("Thing")
    rows = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), label.alias("label"), F.col("o_orderstatus").alias("name"), F.split("o_orderpriority", " ").alias("aliases"), F.col("o_orderkey").alias("provenance"))
    return knowledge.upsert_nodes(knowledge.known_labels(rows))


def _order_edges(spark, sf_dir) -> DataFrame:
    line = T(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("provenance"))


NODES = "SELECT p_partkey AS id FROM part WHERE p_size < 40"


@query(f"""WITH n AS ({NODES}) SELECT l_suppkey AS src, l_returnflag AS rel, l_partkey AS dst, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS provenance FROM lineitem
WHERE l_suppkey IN (SELECT id FROM n) AND l_partkey IN (SELECT id FROM n) GROUP BY ALL""")
def edge_dedup_endpoints(spark, sf_dir):
    return knowledge.upsert_edges(_order_edges(spark, sf_dir), T(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id")))


@query(f"""WITH n AS ({NODES}) SELECT l_returnflag AS rel, count(*) AS edges, count(*) FILTER (l_suppkey NOT IN (SELECT id FROM n) OR l_partkey NOT IN (SELECT id FROM n)) AS missing FROM lineitem GROUP BY l_returnflag""")
def edge_missing_counts(spark, sf_dir):
    return knowledge.missing_ends(_order_edges(spark, sf_dir), T(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id")))


@query("""WITH m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS c FROM part)
SELECT DISTINCT s.c AS src, l_returnflag AS rel, d.c AS dst FROM lineitem JOIN m s ON s.id = l_suppkey JOIN m d ON d.id = l_partkey
WHERE NOT ((s.id <> s.c OR d.id <> d.c) AND s.c = d.c)""")
def consolidate_nodes(spark, sf_dir):
    part = T(spark, sf_dir, "part")
    least = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("canonical"))
    mapping = part.join(least, ["p_brand", "p_size"]).select(F.col("p_partkey").alias("id"), "canonical")
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    held = _order_edges(spark, sf_dir).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return knowledge.consolidate(nodes, held, mapping)[1]


@query("""SELECT event_id, length(event_type) BETWEEN 2 AND 80 AND value >= 50 AND (json_extract_string(props, '$.k'))::INTEGER <> 7 AS valid FROM events""")
def validate_extraction(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    quote = F.when(F.col("value") >= 50, F.lit("a quoted line")).otherwise("short")
    entity = F.struct(F.col("event_type").alias("name"), F.when(k == 7, "Nothing").otherwise("Object").alias("type"), F.array().cast("array<string>").alias("aliases"))
    event = F.struct(F.lit("some event").alias("name"), F.array().cast("array<string>").alias("participants"), F.array().cast("array<string>").alias("objects"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("date"), F.lit("year").alias("date_precision"), quote.alias("evidence_quote"))
    raw = F.to_json(F.struct(F.array(entity).alias("entities"), F.array(event).alias("events")))
    return T(spark, sf_dir, "events").select("event_id", knowledge.gate(F.from_json(raw, knowledge.EXTRACTION)).alias("valid"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INTEGER AS k FROM events")
def explode_props(spark, sf_dir):
    return T(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT CASE WHEN r = 'AFTER' THEN b ELSE a END AS src, CASE WHEN r = 'AFTER' THEN 'BEFORE' ELSE r END AS rel, CASE WHEN r = 'AFTER' THEN a ELSE b END AS dst
FROM (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_linenumber % 3 = 0 THEN 'AFTER' WHEN l_linenumber % 3 = 1 THEN 'BEFORE' ELSE 'DURING' END AS r FROM lineitem) WHERE a <> b""")
def temporal_canonicalisation(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    return knowledge.temporal_edges(T(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(n == 0, "AFTER").when(n == 1, "BEFORE").otherwise("DURING").alias("rel")))


# -- graph ---------------------------------------------------------------------------------

GRAPH_SQL = """nodes AS (SELECT 'n' || n_nationkey AS id, 'Nation' AS label, n_name AS name FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier),
edges AS (SELECT 'c' || c_custkey AS src, 'LIVES_IN' AS rel, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'BASED_IN', 'n' || s_nationkey FROM supplier)"""
RANKS = {"Nation": 0, "Supplier": 1, "Customer": 2}
RANK_SQL = "CASE label WHEN 'Nation' THEN 0 WHEN 'Supplier' THEN 1 WHEN 'Customer' THEN 2 ELSE 9 END"


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    def named(table, prefix, key, name, label):
        return T(spark, sf_dir, table).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))

    def linked(table, prefix, key, to, rel):
        return T(spark, sf_dir, table).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit("n"), F.col(to).cast("string")).alias("dst"))

    nodes = named("nation", "n", "n_nationkey", "n_name", "Nation").union(named("customer", "c", "c_custkey", "c_name", "Customer")).union(named("supplier", "s", "s_suppkey", "s_name", "Supplier"))
    return nodes, linked("customer", "c", "c_custkey", "c_nationkey", "LIVES_IN").union(linked("supplier", "s", "s_suppkey", "s_nationkey", "BASED_IN"))


LOOKUP_SQL = f"""q(name) AS (VALUES ('NATION_1'), ('000000012'), ('Supplier#00000000'), ('no such name')),
near AS (SELECT q.name AS qn, n.id, n.label, CASE WHEN lower(n.name) = lower(q.name) THEN 0 ELSE 1 END AS tier FROM nodes n JOIN q ON contains(lower(n.name), lower(q.name))),
best AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY id) AS p FROM (SELECT *, min(tier) OVER (PARTITION BY qn) AS b FROM near) WHERE tier = b),
found AS (SELECT qn AS name, id, label, row_number() OVER (PARTITION BY qn ORDER BY {RANK_SQL}, id)::INTEGER AS rank FROM best WHERE p <= 24 QUALIFY rank <= 4)"""


def _lookup(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    names = spark.createDataFrame([("NATION_1",), ("000000012",), ("Supplier#00000000",), ("no such name",)], "name string")
    return lookup(nodes, names, RANKS), edges


@query(f"WITH {GRAPH_SQL}, {LOOKUP_SQL} SELECT name, id, label, rank FROM found")
def entity_lookup_ranked(spark, sf_dir):
    return _lookup(spark, sf_dir)[0]


@query(f"""WITH {GRAPH_SQL}, {LOOKUP_SQL}, u AS (SELECT src AS id, rel, dst AS other FROM edges UNION SELECT dst, rel, src FROM edges),
k AS (SELECT id, other, rel, row_number() OVER (PARTITION BY id ORDER BY other, rel) AS r FROM u WHERE id IN (SELECT id FROM found))
SELECT f.name, f.id, coalesce((SELECT string_agg(other || ' ' || rel, ',' ORDER BY other, rel) FROM k WHERE k.id = f.id AND r <= 6), '') AS neighbours FROM found f""")
def neighbors_capped(spark, sf_dir):
    found, edges = _lookup(spark, sf_dir)
    near = F.array_join(F.transform("neighbours", lambda n: F.concat(n["other"], F.lit(" "), n["rel"])), ",")
    return graph.neighbours(found, edges).select("name", "id", near.alias("neighbours"))


@query("""WITH o AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS cust, CASE o_orderstatus WHEN 'O' THEN 'Event' WHEN 'F' THEN 'Movie' ELSE 'Series' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'OCCURS_IN' ELSE 'DEPICTED_IN' END AS rel, 'timeline:' || o_orderpriority AS scope FROM orders),
inside AS (SELECT id, cust FROM o WHERE scope = 'timeline:1-URGENT' AND (label = 'Event' AND rel = 'OCCURS_IN' OR label = 'Movie' AND rel = 'DEPICTED_IN'))
SELECT DISTINCT cust AS id FROM inside UNION SELECT DISTINCT 'p' || l_partkey FROM inside JOIN lineitem ON 'o' || l_orderkey = inside.id WHERE l_linenumber > 1""")
def scope_witness(spark, sf_dir):
    """Customers take part in orders, which involve parts (the first line only mentions its part); an order is an event, a film or a series of its priority's timeline."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    orders = T(spark, sf_dir, "orders").withColumn("id", key("o", "o_orderkey"))
    label = F.when(F.col("o_orderstatus") == "O", "Event").when(F.col("o_orderstatus") == "F", "Movie").otherwise("Series")
    rel = F.when(F.col("o_orderkey") % 2 == 0, "OCCURS_IN").otherwise("DEPICTED_IN")
    scope = F.concat(F.lit("timeline:"), "o_orderpriority")
    edges = orders.select(F.col("id").alias("src"), rel.alias("rel"), scope.alias("dst")).union(orders.select(key("c", "o_custkey"), F.lit("PARTICIPATES_IN"), "id"))
    edges = edges.union(T(spark, sf_dir, "lineitem").select(key("o", "l_orderkey"), F.when(F.col("l_linenumber") > 1, "INVOLVES").otherwise("MENTIONS"), key("p", "l_partkey")))
    nodes = orders.select("id", label.alias("label"))
    others = T(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("id")).union(T(spark, sf_dir, "part").select(key("p", "p_partkey")))
    return graph.witnesses(others, edges, nodes, "timeline:1-URGENT")


NEXT_SQL = """WITH RECURSIVE e AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
w AS (SELECT event_id AS start, event_id AS node, 0 AS hop FROM events
UNION ALL SELECT w.start, {to}, w.hop + 1 FROM w JOIN e ON e.{at} = w.node AND e.b IS NOT NULL WHERE w.hop < 3)
SELECT start, node, min(hop)::INTEGER AS hop FROM w WHERE hop > 0 GROUP BY start, node"""


def _walk(spark, sf_dir, backward: bool):
    events = T(spark, sf_dir, "events")
    following = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select(F.col("event_id").alias("src"), following.alias("dst")).where("dst is not null")
    return graph.walk(edges, events.select(F.col("event_id").alias("id")), 3, backward)


@query(NEXT_SQL.format(to="e.b", at="a"))
def temporal_walk_next(spark, sf_dir):
    return _walk(spark, sf_dir, False)


@query(NEXT_SQL.format(to="e.a", at="b"))
def temporal_walk_prev(spark, sf_dir):
    return _walk(spark, sf_dir, True)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, l AS (SELECT src, dst FROM edges UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), u AS (SELECT src AS x, dst AS y FROM l UNION SELECT dst, src FROM l),
pairs(a, b) AS (VALUES ('c1', 's1'), ('c2', 'c3'), ('s1', 's2'), ('n0', 'c4'), ('n1', 'c5'), ('c7', 'r1')),
e AS (SELECT x, y FROM u WHERE (x LIKE 'n%' OR x LIKE 'r%' OR x IN (SELECT a FROM pairs UNION SELECT b FROM pairs)) AND (y LIKE 'n%' OR y LIKE 'r%' OR y IN (SELECT a FROM pairs UNION SELECT b FROM pairs))),
p AS (SELECT a, b, a AS node, [a] AS path FROM pairs
UNION ALL SELECT p.a, p.b, e.y, list_append(p.path, e.y) FROM p JOIN e ON e.x = p.node WHERE p.node <> p.b AND len(p.path) <= 5 AND NOT list_contains(p.path, e.y))
SELECT a, b, (len(path) - 1)::INTEGER AS hops, array_to_string(path, ' -> ') AS path FROM p WHERE node = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1""")
def shortest_connection(spark, sf_dir):
    pairs = spark.createDataFrame([("c1", "s1"), ("c2", "c3"), ("s1", "s2"), ("n0", "c4"), ("n1", "c5"), ("c7", "r1")], "a string, b string")
    regions = T(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("IN").alias("rel"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return graph.shortest_paths(_graph(spark, sf_dir)[1].union(regions), pairs).select("a", "b", "hops", F.array_join("path", " -> ").alias("path"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, r_name AS parent_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region")
def scope_tree(spark, sf_dir):
    parent = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    nation = T(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), parent.alias("parent"))
    region = T(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    return graph.scope_tree(nation.union(region))


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_type AS label, CASE WHEN contains(lower(p_name), 'a lost gear') OR contains('a lost gear', lower(p_name)) THEN 0
  WHEN len(list_filter(['gear', 'hot', 'lost'], lambda t: contains(lower(p_name), t))) > 0 THEN 1 END AS tier, len(list_filter(['gear', 'hot', 'lost'], lambda t: contains(lower(p_name), t))) AS hits FROM part)
SELECT id, name, label, hits::INTEGER AS hits FROM s WHERE tier = (SELECT min(tier) FROM s) ORDER BY -hits, id LIMIT 3""")
def token_overlap_endpoint(spark, sf_dir):
    nodes = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("label"))
    return graph.endpoint_candidates(nodes, "a lost gear", ["gear", "hot", "lost"])


# -- incremental ---------------------------------------------------------------------------

@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, sf_dir):
    return incremental.todo(T(spark, sf_dir, "documents").select("doc_id"), T(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'hit' WHEN ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY THEN 'miss' ELSE 'expired' END AS state FROM events")
def ttl_cache(spark, sf_dir):
    return incremental.cache_state(T(spark, sf_dir, "events"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), F.col("event_type") == "purchase", "ts").select("event_id", "state")


@query("SELECT strftime(ts, '%Y-%m-%d') AS utc_day, count(*) FILTER (event_type = 'click') AS used, greatest(0, 80 - count(*) FILTER (event_type = 'click'))::BIGINT AS remaining FROM events GROUP BY 1")
def daily_budget(spark, sf_dir):
    return incremental.daily_use(T(spark, sf_dir, "events"), F.col("ts"), F.col("event_type") == "click", 80)


@query("SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id FROM events WHERE value > 20 GROUP BY user_id")
def latest_success(spark, sf_dir):
    return incremental.latest_success(T(spark, sf_dir, "events"), "user_id", F.col("value") > 20, ["ts", "event_id"], "event_id")


# -- grounding -----------------------------------------------------------------------------

ANSWER_SQL = "SELECT conv_id, string_agg(regexp_replace(text, '([.!?])( |$)', '\\1 [' || (1 + turn % 4) || ']\\2', 'g'), ' ' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id"


def _answers(spark, sf_dir) -> DataFrame:
    """All turns of a conversation, in order, as one answer."""
    mark = F.concat(F.lit("$1 ["), (1 + F.col("turn") % 4).cast("string"), F.lit("]$2"))
    marked = T(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.regexp_replace("text", F.lit("([.!?])( |$)"), mark).alias("text")).alias("t"))
    return marked.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("t"))["text"], " ").alias("answer"))


def _evidence(spark, sf_dir) -> DataFrame:
    return T(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("slot"), F.col("text").alias("quote"), F.col("role").alias("title"))


@query(f"SELECT DISTINCT conv_id, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))::INTEGER AS slot FROM ({ANSWER_SQL})")
def citation_parse(spark, sf_dir):
    return grounding.cited_slots(_answers(spark, sf_dir), "conv_id", "answer")


FAITHFUL_SQL = rf"""WITH a AS ({ANSWER_SQL}),
g AS (SELECT conv_id, regexp_replace(regexp_replace(answer, '([.!?])\s*(\[\d+\])', '\1\2', 'g'), '([.!?\]])\s+([A-Z])', '\1' || chr(1) || '\2', 'g') AS t FROM a),
s AS (SELECT conv_id, unnest(list_filter(string_split(t, chr(1)), lambda x: trim(x) <> '')) AS sentence, unnest(range(len(list_filter(string_split(t, chr(1)), lambda x: trim(x) <> '')))) AS n FROM g),
c AS (SELECT *, list_distinct(regexp_extract_all(sentence, '\[(\d+)\]', 1)) AS cites FROM s),
e AS (SELECT conv_id, turn + 1 AS slot, text FROM conversations),
q AS (SELECT c.conv_id, c.n, string_agg(e.text, ' ') AS quotes FROM c JOIN e ON e.conv_id = c.conv_id AND list_contains(c.cites, e.slot::VARCHAR) GROUP BY c.conv_id, c.n),
w AS (SELECT c.conv_id, c.n, c.sentence, len(cites) > 0 AS cited, quotes,
  list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(c.sentence, '\[\d+\]', '', 'g')), '[a-z]{{4,}}'), lambda x: NOT list_contains({X.FUNCTION_WORDS!r}, x))) AS words,
  list_distinct(list_filter(regexp_extract_all(lower(coalesce(quotes, '')), '[a-z]{{4,}}'), lambda x: NOT list_contains({X.FUNCTION_WORDS!r}, x))) AS shown
  FROM c LEFT JOIN q ON q.conv_id = c.conv_id AND q.n = c.n)
SELECT conv_id, n::INTEGER AS n, sentence, CASE WHEN NOT cited OR quotes IS NULL OR len(words) = 0 THEN false ELSE len(list_intersect(words, shown)) >= 0.2 * len(words) END AS faithful FROM w"""


@query(FAITHFUL_SQL)
def faithfulness_overlap(spark, sf_dir):
    return grounding.sentence_verdicts(_answers(spark, sf_dir), _evidence(spark, sf_dir), "conv_id", "answer")


@query(f"""WITH a AS ({ANSWER_SQL}), cited AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))::INTEGER AS slot FROM a),
e AS (SELECT conv_id, turn + 1 AS slot, role AS title FROM conversations),
u AS (SELECT a.conv_id, 'user' AS title, 0 AS o FROM a WHERE a.conv_id IN (SELECT conv_id FROM e WHERE title = 'user')
UNION ALL SELECT e.conv_id, e.title, e.slot + 1000 FROM e JOIN cited USING (conv_id, slot)),
k AS (SELECT conv_id, title, min(o) AS o FROM u GROUP BY ALL)
SELECT conv_id, string_agg(title, ';' ORDER BY o, title) AS titles FROM k GROUP BY conv_id""")
def source_titles(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    claimed = answers.select("conv_id", F.lit(0).alias("n"), F.lit("user").alias("title"))
    found = grounding.source_titles(claimed, grounding.cited_slots(answers, "conv_id", "answer"), _evidence(spark, sf_dir), "conv_id")
    return found.select("conv_id", F.array_join("titles", ";").alias("titles"))


# -- evaluation ----------------------------------------------------------------------------

GRADED_SQL = """r AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank,
  CASE WHEN event_type <> 'click' THEN 0 WHEN value IS NULL THEN 1 WHEN extract(day FROM ts) BETWEEN 8 AND 14 THEN 3 WHEN extract(day FROM ts) BETWEEN 5 AND 17 THEN 2 ELSE 1 END AS grade FROM events),
t AS (SELECT * FROM r WHERE rank <= 12), i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, rank) AS ir FROM t),
m AS (SELECT case_id, max(CASE WHEN grade >= 1 AND rank <= 6 THEN 1 ELSE 0 END) AS evidence6, """ + ", ".join(f"max(CASE WHEN grade >= {g} AND rank <= {k} THEN 1 ELSE 0 END) AS {n}_recall_{k}" for n, g in (("doc", 1), ("chunk", 2)) for k in (1, 3, 6, 12)) + """,
  coalesce(1.0 / min(rank) FILTER (grade >= 1), 0)::DOUBLE AS doc_rr, coalesce(1.0 / min(rank) FILTER (grade >= 2), 0)::DOUBLE AS chunk_rr,
  CASE WHEN sum(grade / log2(ir + 1)) > 0 THEN sum(grade / log2(rank + 1)) / sum(grade / log2(ir + 1)) ELSE 0 END AS ndcg FROM i GROUP BY case_id)"""


def _graded(spark, sf_dir) -> DataFrame:
    day = F.dayofmonth("ts")
    seven, near = evaluation.overlaps(day, day, F.lit(8), F.lit(14)), evaluation.overlaps(day, day, F.lit(5), F.lit(17))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return T(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), rank.alias("rank"), evaluation.grade(F.col("event_type") == "click", F.col("value").isNotNull(), seven, near).alias("grade"))


@query(f"WITH {GRADED_SQL} SELECT case_id, rank, grade FROM r")
def eval_grades(spark, sf_dir):
    return _graded(spark, sf_dir)


@query(f"WITH {GRADED_SQL} SELECT case_id, evidence6, " + ", ".join(f"{n}_recall_{k}" for n in ("doc", "chunk") for k in (1, 3, 6, 12)) + " FROM m")
def recall_at_k(spark, sf_dir):
    return evaluation.case_metrics(_graded(spark, sf_dir)).drop("doc_rr", "chunk_rr", "ndcg")


@query(f"WITH {GRADED_SQL} SELECT case_id, round(doc_rr, 9) AS doc_rr, round(chunk_rr, 9) AS chunk_rr FROM m")
def mrr(spark, sf_dir):
    return evaluation.case_metrics(_graded(spark, sf_dir)).select("case_id", F.round("doc_rr", 9).alias("doc_rr"), F.round("chunk_rr", 9).alias("chunk_rr"))


@query(f"WITH {GRADED_SQL} SELECT case_id, round(ndcg, 9) AS ndcg FROM m")
def ndcg(spark, sf_dir):
    return evaluation.case_metrics(_graded(spark, sf_dir)).select("case_id", F.round("ndcg", 9).alias("ndcg"))


@query(f"""WITH {GRADED_SQL}, a AS (SELECT round(avg(evidence6), 4) AS e, round(avg(chunk_recall_6), 4) AS c, round(avg(chunk_rr), 4) AS q FROM m)
SELECT round(0.5 * e + 0.25 * c + 0.25 * q, 4) AS primary_metric FROM a""")
def primary_metric(spark, sf_dir):
    graded = _graded(spark, sf_dir)
    return evaluation.report(graded.select("case_id").distinct(), evaluation.case_metrics(graded)).select("primary_metric")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 7) * 40000000000 AS t FROM events)
SELECT a.event_id, max(b.t) FILTER (b.t < a.s) AS previous_end, arg_min(b.t, (b.s, b.t)) FILTER (b.s > a.t) AS next_end FROM e a JOIN e b USING (user_id) GROUP BY a.event_id""")
def asof_neighbor_windows(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    events = T(spark, sf_dir, "events").select("event_id", "user_id", start.alias("s"), (start + (F.col("event_id") % 7) * 40_000_000_000).alias("t"))
    return evaluation.around(events, "user_id", "s", "t", "event_id").select("event_id", "previous_end", "next_end")


@query(f"""WITH b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM (SELECT item_id, {TERMS_SQL} AS w FROM benchmark))),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM (SELECT doc_id, {TERMS_SQL} AS w FROM documents)))
SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (g) GROUP BY item_id, doc_id""")
def ngram_overlap(spark, sf_dir):
    return lexical.ngram_overlap(T(spark, sf_dir, "documents"), T(spark, sf_dir, "benchmark"), 6)


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id)::INTEGER AS pick FROM documents QUALIFY pick <= 5")
def stratified_sample(spark, sf_dir):
    return evaluation.stratified(T(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 5)


# -- sources -------------------------------------------------------------------------------

@query("""SELECT * FROM (VALUES ('alpha', NULL, NULL, 'doc:alpha'), ('beta', 1, 1, 'doc:beta_s01e01'), ('beta', 1, 2, 'doc:beta_s01e02'), ('beta', 2, 1, 'doc:beta_s02e01')) t(slug, season, episode, document_id)""")
def target_explode(spark, sf_dir):
    rows = '[{"slug": "alpha", "title": "Alpha", "type": "movie", "animated": false}, {"slug": "beta", "title": "Beta", "type": "series", "animated": false, "seasons": [1, 2], "episode_counts": {"1": 2, "2": 1}}, {"slug": "gamma", "title": "Gamma", "type": "movie", "animated": true}]'
    return tables.targets(tables.inventory_of(spark, rows))


@query(r"""WITH n AS (SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS r FROM pages)
SELECT page_id, (8 + CASE WHEN regexp_matches(r, '\bweb[\s.|-]*(dl|rip)\b') OR contains(r, 'dsnp') OR contains(r, 'bluray') OR contains(r, 'web') THEN 1 ELSE 0 END - CASE WHEN contains(r, 'www.') OR contains(r, 'http') THEN 2 ELSE 0 END)::INTEGER AS score
FROM n WHERE contains(r, 'example com')""")
def release_rank(spark, sf_dir):
    pages = T(spark, sf_dir, "pages").select("page_id", F.col("url").alias("release"))
    return releases.ranked(pages, "release", "example com").select("page_id", "score")


@query("""SELECT host, arg_min(page_id, (-length(url), page_id)) AS page_id FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) GROUP BY host""")
def best_hit(spark, sf_dir):
    pages = T(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    hit = pages.withColumn("ai", F.lit(False)).withColumn("hearing_impaired", F.lit(False)).withColumn("preferred", F.lit(False))
    return releases.best(hit, "host", "url", "page_id").select("host", "page_id")


@query("SELECT 'document' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY event_type")
def type_counts(spark, sf_dir):
    docs = T(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    events = T(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return docs.select(F.lit("document").alias("kind"), "name", "n").union(events.select(F.lit("event"), "name", "n"))


@query("SELECT doc_id, lang FROM documents WHERE starts_with(source, 'src1') AND length(text) BETWEEN 150 AND 800")
def prefix_and_length_filter(spark, sf_dir):
    return T(spark, sf_dir, "documents").where(F.col("source").startswith("src1") & F.length("text").between(150, 800)).select("doc_id", "lang")
