"""Registered queries of subtitle files, releases, inventories, answers and path evidence, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.catalog_queries import T, canonical_sql, query
from lantern.catalog_records import ORACLES, QUERIES
from lantern.functions import text as X
from lantern.operators import fusion, grounding, knowledge
from lantern.sources import releases, subtitles, tables

__all__ = ["ORACLES", "QUERIES"]


# -- subtitle files ------------------------------------------------------------------------

@query(r"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS cue, turn, text FROM conversations WHERE turn < 60 AND trim(text, chr(10) || ' ') <> '')
SELECT conv_id, cue, (turn * 2.0)::DOUBLE AS start_s, (turn * 2.0 + 1.5)::DOUBLE AS end_s, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text FROM c""")
def subtitle_cues(spark, sf_dir):
    turns = T(spark, sf_dir, "conversations").where("turn < 60 and trim(both '\\n ' from text) <> ''")
    at = lambda plus, end: F.format_string(f"00:%02d:%02d,{end}", F.floor(F.col("turn") * 2 / 60).cast("int"), ((F.col("turn") * 2) % 60 + plus).cast("int"))
    shown = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), at(0, "000"), F.lit(" --> "), at(1, "500"), F.lit("\n"), "text")
    held = F.transform(F.array_sort(F.collect_list(F.struct("turn", shown.alias("shown")))), lambda x: x["shown"])  # a file of 60 cues at most
    files = turns.groupBy("conv_id").agg(F.encode(F.concat(F.lit("﻿"), F.array_join(held, "\n\n")), "UTF-8").alias("content"))
    cues = subtitles.cues_of(files.select(F.col("conv_id").cast("string").alias("path"), "content"))
    return cues.select(F.col("path").cast("long").alias("conv_id"), "cue", "start_s", "end_s", "text")


FILES_SQL = "files AS (SELECT doc_id, repeat('0 --> 1 ', (doc_id % 300)::INTEGER) || CASE WHEN doc_id % 7 = 0 THEN '<HTML>' ELSE '' END || text AS text FROM documents)"


@query(f"""WITH {FILES_SQL} SELECT doc_id FROM files
WHERE (length(text) - length(replace(text, '-->', ''))) / 3 >= 150 AND strlen(text) >= 2000 AND NOT contains(lower(left(text, 400)), '<html')""")
def usable_subtitles(spark, sf_dir):
    page = F.when(F.col("doc_id") % 7 == 0, "<HTML>").otherwise("")
    files = T(spark, sf_dir, "documents").select("doc_id", F.concat(F.expr("repeat('0 --> 1 ', cast(doc_id % 300 as int))"), page, "text").alias("text"))
    return subtitles.usable(files).select("doc_id")


# -- releases and inventories --------------------------------------------------------------

@query("""WITH f AS (SELECT page_id, url || '/Show.S01E' || page_id || CASE WHEN page_id % 3 = 0 THEN '-en.srt' WHEN page_id % 3 = 1 THEN '.srt' ELSE '' END AS u FROM pages)
SELECT page_id, regexp_replace(regexp_extract(u, '([^/]*)$', 1), '(-en)?\\.srt$', '') AS release FROM f""")
def release_names(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, "-en.srt").when(F.col("page_id") % 3 == 1, ".srt").otherwise("")
    return T(spark, sf_dir, "pages").select("page_id", releases.release_of(F.concat("url", F.lit("/Show.S01E"), F.col("page_id").cast("string"), end)).alias("release"))


@query("""SELECT page_id, regexp_extract(h, 'href="([^"]*-en\\.srt)"', 1) AS file FROM (
SELECT page_id, html || CASE WHEN page_id % 2 = 0 THEN '<a href="/d/' || page_id || '-fr.srt">x</a><a href="/d/' || page_id || '-en.srt">x</a><a href="/e-en.srt">x</a>' ELSE '' END AS h FROM pages)""")
def english_files(spark, sf_dir):
    n = F.col("page_id").cast("string")
    more = F.concat(F.lit('<a href="/d/'), n, F.lit('-fr.srt">x</a><a href="/d/'), n, F.lit('-en.srt">x</a><a href="/e-en.srt">x</a>'))
    return T(spark, sf_dir, "pages").select("page_id", releases.english_file(F.concat("html", F.when(F.col("page_id") % 2 == 0, more).otherwise(""))).alias("file"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_name || ' ' || (1980 + p_size), p_name]
ELSE [printf('%s S%02dE%02d', p_name, p_size % 9, (p_partkey % 24 + 1)::INTEGER), printf('%s %dx%02d', p_name, p_size % 9, (p_partkey % 24 + 1)::INTEGER), p_name] END AS variants FROM part""")
def search_variants(spark, sf_dir):
    series = F.col("p_partkey") % 3 != 0
    season, episode = F.when(series, F.col("p_size") % 9), F.when(series, (F.col("p_partkey") % 24 + 1).cast("int"))
    return T(spark, sf_dir, "part").select("p_partkey", releases.query_variants(F.col("p_name"), F.col("p_size") + 1980, season, episode).alias("variants"))


def _inventory(spark, sf_dir) -> DataFrame:
    """A film or series for each customer: seasons by order status, as many episodes as orders."""
    orders = T(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("season"))
    counts = orders.groupBy("o_custkey", "season").agg(F.count("*").cast("int").alias("n"))
    held = counts.groupBy("o_custkey").agg(F.sort_array(F.collect_list("season")).alias("seasons"), F.map_from_entries(F.collect_list(F.struct(F.col("season").cast("string"), "n"))).alias("episode_counts"))  # three at most
    slug = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    kind = F.when(F.col("o_custkey") % 5 == 0, "movie").otherwise("series")
    return held.select(slug.alias("slug"), kind.alias("type"), (F.col("o_custkey") % 11 == 0).alias("animated"), "seasons", "episode_counts")


@query("SELECT 'c' || o_custkey AS slug, count(*)::INTEGER AS episodes FROM orders GROUP BY o_custkey")
def inventory_episodes(spark, sf_dir):
    return tables.episodes_by_title(_inventory(spark, sf_dir))


@query("""WITH o AS (SELECT o_custkey AS c, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS season FROM orders WHERE o_custkey % 11 <> 0)
SELECT DISTINCT 'c' || c AS slug, NULL::INTEGER AS season, NULL::INTEGER AS episode, 'doc:c' || c AS document_id FROM o WHERE c % 5 = 0
UNION ALL SELECT 'c' || c, season, e, printf('doc:c%d_s%02de%02d', c, season, e) FROM (SELECT c, season, unnest(range(1, count(*) + 1))::INTEGER AS e FROM o WHERE c % 5 <> 0 GROUP BY c, season)""")
def inventory_targets(spark, sf_dir):
    return tables.targets(_inventory(spark, sf_dir))


# -- answers and evidence ------------------------------------------------------------------

@query(r"""WITH b AS (SELECT conv_id, turn, 'ANSWER: ' || text || chr(10) || 'UNCERTAINTY:  ' || role || chr(10) || 'SOURCES: alpha; beta, ' || role || ' ' || turn || '.;;' AS block FROM conversations)
SELECT conv_id, turn, trim(regexp_extract(block, '(?s)ANSWER:\s*(.*?)\n(?:ANSWER|UNCERTAINTY|SOURCES):', 1)) AS answer, trim(regexp_extract(block, '(?s)UNCERTAINTY:\s*(.*?)\n(?:ANSWER|UNCERTAINTY|SOURCES):', 1)) AS uncertainty,
list_filter(list_transform(string_split_regex(trim(regexp_extract(block, '(?s)SOURCES:\s*(.*)$', 1)), '[;,]'), lambda x: trim(x, ' ,.' || chr(10))), lambda x: x <> '') AS sources FROM b""")
def answer_blocks(spark, sf_dir):
    block = F.concat(F.lit("ANSWER: "), "text", F.lit("\nUNCERTAINTY:  "), "role", F.lit("\nSOURCES: alpha; beta, "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit(".;;"))
    answer, uncertainty, sources = grounding.answer_sections(block)
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), uncertainty.alias("uncertainty"), sources.alias("sources"))


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, p.replace("'", "''")) for p in phrases) + ")"


@query(f"""WITH s AS (SELECT conv_id, turn, lower(text) AS s, turn % 2 = 0 AS cited FROM conversations)
SELECT conv_id, turn, {_any("s", X.HEDGES)} OR ({_any("s", X.META)} AND (NOT cited OR {_any("s", X.REPORTING)})) AS hedge FROM s""")
def hedged_turns(spark, sf_dir):
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_hedge(F.col("text"), F.col("turn") % 2 == 0).alias("hedge"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}\s''-]', '', 'g')) AS term FROM conversations")
def sanitized_terms(spark, sf_dir):
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", X.sanitized(F.col("text")).alias("term"))


@query(f"""WITH e AS (SELECT 'event:' || event_id AS id, 'User ' || (user_id % 50) AS who, event_type AS what, CASE WHEN event_id % 4 > 0 THEN 'The ' || event_type || ' room' END AS place FROM events)
SELECT {canonical_sql("'character'", "who")} AS src, 'PARTICIPATES_IN' AS rel, id AS dst FROM e UNION ALL SELECT id, 'INVOLVES', {canonical_sql("'object'", "what")} FROM e
UNION ALL SELECT id, 'OCCURS_AT', {canonical_sql("'location'", "place")} FROM e WHERE place IS NOT NULL""")
def event_fanout(spark, sf_dir):
    place = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("The "), "event_type", F.lit(" room")))
    who = F.concat(F.lit("User "), (F.col("user_id") % 50).cast("string"))
    events = T(spark, sf_dir, "events").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("event_id"), F.array(who).alias("participants"), F.array("event_type").alias("objects"), place.alias("location"))
    return knowledge.event_edges(events)


@query("SELECT l_orderkey AS id, string_agg(l_shipmode, ' -> ' ORDER BY l_linenumber, l_shipmode) AS quote FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS l_shipmode FROM lineitem) GROUP BY l_orderkey")
def path_evidence(spark, sf_dir):
    stops = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "name"))), lambda x: x["name"])  # the lines of one order
    return stops.groupBy(F.col("l_orderkey").alias("id")).agg(fusion.path_quote(names).alias("quote"))
