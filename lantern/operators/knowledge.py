"""Entity resolution, the extraction gate and idempotent graph loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.functions.text import canonical_id
from lantern.operators.graph import components, small
from lantern.plans.lineage import cut

# Labels and relations that a graph may hold.
LABELS = ["Character", "Event", "Movie", "Series", "Episode", "Location", "Object", "Organization", "Timeline"]
ENTITY_TYPES = ["Character", "Event", "Location", "Object", "Organization"]
RELATIONS = ["PARTICIPATES_IN", "USES", "MEMBER_OF", "OCCURS_AT", "CAUSES", "KNOWS", "ENEMY_OF", "ALLIED_WITH", "FAMILY_OF", "ROMANTIC_WITH"]
EXTRACTION = (
    "struct<entities:array<struct<name:string,type:string,aliases:array<string>>>,"
    "events:array<struct<name:string,participants:array<string>,objects:array<string>,location:string,date:string,date_precision:string,evidence_quote:string>>,"
    "relations:array<struct<source:string,relation:string,target:string,evidence_quote:string>>,"
    "temporals:array<struct<event_a:string,event_b:string,relation:string,evidence_quote:string>>>"
)


def resolve(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """`entity_id` of mentions (name, kind): the alias's only entity, else the first of the kind, else the first; else a fresh id.

    aliases: (alias, entity_id, kind, position). Two rows of a few bytes stand for all candidates of an alias: the first, and the first of each kind.
    """
    index = aliases.select(F.lower(F.trim("alias")).alias("_key"), F.col("kind").alias("_kind"), F.struct("position", F.col("entity_id").alias("id")).alias("c"))
    of_kind = index.groupBy("_key", "_kind").agg(F.min("c").alias("_same"))
    first = of_kind.groupBy("_key").agg(F.min("_same").alias("_any"))
    held = mentions.withColumn("_key", F.lower(F.trim("name"))).join(first, "_key", "left")
    held = held.join(of_kind.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & (F.col("kind") == F.col("_kind")), "left")
    found = F.coalesce(F.col("_same.id"), F.col("_any.id"), canonical_id(F.lower("kind"), F.col("name")))
    return held.withColumn("entity_id", found).drop("_key", "_k", "_kind", "_same", "_any")


def register(mentions: DataFrame) -> DataFrame:
    """(entity_id, name, aliases): mentions (seq, name, kind, alias array) merged by canonical id; first name, sorted union of aliases."""
    named = mentions.withColumn("entity_id", canonical_id(F.lower("kind"), F.col("name")))
    return named.groupBy("entity_id").agg(F.min_by("name", "seq").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("alias")))).alias("aliases"))


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """Merge (seq, id, name, aliases, provenance): first name, longest alias list (earliest of equals), latest provenance."""
    return rows.groupBy("id").agg(F.min_by("name", "seq").alias("name"), F.max_by("aliases", F.struct(F.size("aliases"), -F.col("seq"))).alias("aliases"), F.max_by("provenance", "seq").alias("provenance"))


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (seq, src, rel, dst, provenance) of which both ends exist; the first of each (src, rel, dst)."""
    ids = nodes.select("id")
    held = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held.groupBy("src", "rel", "dst").agg(F.min_by("provenance", "seq").alias("provenance"))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel, edges, missing): rows of each relation, and those without one end or both."""
    ids = nodes.select("id").distinct()
    held = edges.join(ids.select(F.col("id").alias("src"), F.lit(1).alias("_a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("_b")), "dst", "left")
    return held.groupBy("rel").agg(F.count("*").alias("edges"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"))


def consolidate(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicate nodes give way to their canonical ones. mapping: (id, canonical)."""
    to = mapping.where("id <> canonical")
    moved = nodes.join(to, "id", "left").withColumn("_self", F.col("canonical").isNull()).withColumn("id", F.coalesce("canonical", "id"))
    kept = moved.groupBy("id").agg(F.min_by("name", F.struct(~F.col("_self"), "name")).alias("name"))
    ends = edges.join(to.select(F.col("id").alias("src"), F.col("canonical").alias("_s")), "src", "left").join(to.select(F.col("id").alias("dst"), F.col("canonical").alias("_d")), "dst", "left")
    ends = ends.select(F.coalesce("_s", "src").alias("src"), "rel", F.coalesce("_d", "dst").alias("dst"), (F.col("_s").isNotNull() | F.col("_d").isNotNull()).alias("_moved"))
    return kept, ends.where("not (_moved and src = dst)").select("src", "rel", "dst").distinct()


def valid_entity(e: Column) -> Column:
    size = F.length(e["name"])
    return F.coalesce(size.between(2, 80) & (F.trim(e["name"]) != "") & ~F.trim(e["name"]).rlike(r"^\d+$") & e["type"].isin(ENTITY_TYPES) & (F.coalesce(F.size(e["aliases"]), F.lit(0)) <= 8), F.lit(False))


def valid_event(e: Column) -> Column:
    few = lambda c: F.coalesce(F.size(e[c]), F.lit(0)) <= 20
    return F.coalesce(
        F.length(e["name"]).between(4, 160) & F.length(e["evidence_quote"]).between(8, 600) & few("participants") & few("objects") & F.coalesce(e["date_precision"], F.lit("unknown")).isin("year", "month", "day", "unknown"), F.lit(False)
    )


def valid_relation(r: Column) -> Column:
    return F.coalesce((F.length(r["source"]) >= 2) & (F.length(r["target"]) >= 2) & r["relation"].isin(RELATIONS) & F.length(r["evidence_quote"]).between(8, 600), F.lit(False))


def valid_temporal(t: Column) -> Column:
    return F.coalesce((F.length(t["event_a"]) >= 2) & (F.length(t["event_b"]) >= 2) & t["relation"].isin("BEFORE", "AFTER", "DURING", "CAUSES") & F.length(t["evidence_quote"]).between(8, 600), F.lit(False))


def gate(x: Column) -> Column:
    """Whether an extraction may reach the graph: every record valid, no list too long."""
    def every(c: str, valid, most: int) -> Column:
        return F.coalesce(F.forall(x[c], valid), F.lit(True)) & (F.coalesce(F.size(x[c]), F.lit(0)) <= most)

    return x.isNotNull() & every("entities", valid_entity, 30) & every("events", valid_event, 10) & every("relations", valid_relation, 30) & every("temporals", valid_temporal, 10)


def without_self_relations(x: Column) -> Column:
    return F.filter(x["relations"], lambda r: F.lower(F.trim(r["source"])) != F.lower(F.trim(r["target"])))


def event_edges(events: DataFrame) -> DataFrame:
    """(src, rel, dst) of events (event_id, participants, objects, location)."""
    who = events.select(F.explode("participants").alias("p"), "event_id").select(canonical_id(F.lit("character"), F.col("p")).alias("src"), F.lit("PARTICIPATES_IN").alias("rel"), F.col("event_id").alias("dst"))
    what = events.select("event_id", F.explode("objects").alias("o")).select(F.col("event_id").alias("src"), F.lit("INVOLVES").alias("rel"), canonical_id(F.lit("object"), F.col("o")).alias("dst"))
    where = events.where("location is not null").select(F.col("event_id").alias("src"), F.lit("OCCURS_AT").alias("rel"), canonical_id(F.lit("location"), F.col("location")).alias("dst"))
    return who.union(what).union(where)


def temporal_edges(pairs: DataFrame) -> DataFrame:
    """(a, rel, b) rows as stored edges: AFTER turned round to BEFORE, no row with itself."""
    after = F.col("rel") == "AFTER"
    return pairs.select(F.when(after, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(after, "BEFORE").otherwise(F.col("rel")).alias("rel"), F.when(after, F.col("a")).otherwise(F.col("b")).alias("dst")).where("src <> dst")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert into a keyed table."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


# -- loading -------------------------------------------------------------------------------


def known_labels(rows: DataFrame) -> DataFrame:
    """Node rows of known labels; others are skipped."""
    return rows.where(F.col("label").isin(LABELS))


def provenance(window: Column, document: Column, title: Column, kind: Column, timeline: Column) -> Column:
    """Where a node or an edge comes from, as JSON of five keys; what isn't known is null."""
    parts = F.struct(window.alias("chunk_id"), document.alias("document_id"), title.alias("source"), kind.alias("source_type"), timeline.alias("timeline_id"))
    return F.to_json(parts, {"ignoreNullFields": "false"})


def scoped_events(events: DataFrame, scopes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges OCCURS_IN and DEPICTED_IN of events (event_id, scope, document_id), and one row of events, and of missing ends."""
    s, d = scopes.select(F.col("id").alias("scope"), F.lit(1).alias("_s")), documents.select(F.col("id").alias("document_id"), F.lit(1).alias("_d"))
    held = events.join(s.distinct(), "scope", "left").join(d.distinct(), "document_id", "left")
    src = F.col("event_id")
    edges = held.where("_s = 1").select(src.alias("src"), F.lit("OCCURS_IN").alias("rel"), F.col("scope").alias("dst"))
    edges = edges.union(held.where("_d = 1").select(src, F.lit("DEPICTED_IN"), F.col("document_id"))).distinct()
    missing = held.agg(F.count("*").alias("events"), F.count_if(F.col("_s").isNull()).alias("no_scope"), F.count_if(F.col("_d").isNull()).alias("no_document"))
    return edges, missing


def document_nodes(documents: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, label, name, src, rel, dst) of documents (document_id, title, type, season, timeline_id) in known scopes: their node and edge."""
    label = F.when(F.col("type") == "movie", "Movie").when(F.col("season").isNotNull(), "Episode").otherwise("Series")
    held = documents.join(scopes.select(F.col("id").alias("timeline_id")).distinct(), "timeline_id")
    return held.select(F.col("document_id").alias("id"), label.alias("label"), F.col("title").alias("name"), F.col("document_id").alias("src"), F.lit("DEPICTED_IN").alias("rel"), F.col("timeline_id").alias("dst"))


def scope_branches(scopes: DataFrame) -> DataFrame:
    """(src, rel, dst) of scopes (id, parent) to those of their parents that are scopes."""
    return scopes.join(scopes.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("id").alias("src"), F.lit("BRANCHES_FROM").alias("rel"), F.col("parent").alias("dst"))


def relation_edges(relations: DataFrame) -> DataFrame:
    """(src, rel, dst) of relations (source, relation, target). Both ends count as characters, whatever the relation; none leads to itself."""
    end = lambda c: canonical_id(F.lit("character"), F.col(c))
    return relations.select(end("source").alias("src"), F.col("relation").alias("rel"), end("target").alias("dst")).where("src <> dst")


def written(edges: DataFrame) -> DataFrame:
    """(rel, written): edges of each relation."""
    return edges.groupBy("rel").agg(F.count("*").alias("written"))


#: Registrations of a window at most; the gate's limits allow about 530.
OF_WINDOW = 1024


def registrations(x: Column) -> Column:
    """All names of an extraction in the order in which they are registered, each with the group of edges it belongs to and its part there.

    array<struct<kind, name, aliases, group, role>>. A group's head is an event, a relation's source or the first event of a pair.
    """
    none = F.array().cast("array<string>")

    def one(kind: Column | str, name: Column, group: Column, role: Column | str, aliases: Column = none) -> Column:
        text = lambda c: F.lit(c) if isinstance(c, str) else c
        return F.struct(text(kind).alias("kind"), name.alias("name"), aliases.alias("aliases"), group.alias("group"), text(role).alias("role"))

    def lists(c: str, f) -> Column:
        return F.coalesce(F.transform(x[c], f), F.array())

    def event(e: Column, i: Column) -> Column:
        group = F.concat(F.lit("e"), i)
        many = lambda c, kind, role: F.transform(F.coalesce(e[c], none), lambda n: one(kind, n, group, role))
        where = F.when(F.coalesce(e["location"], F.lit("")) != "", F.array(one("Location", e["location"], group, "OCCURS_AT"))).otherwise(F.array().cast(PLACE))
        return F.concat(F.array(one("Event", e["name"], group, "head")), many("participants", "Character", "PARTICIPATES_IN"), many("objects", "Object", "INVOLVES"), where)

    def pair(kind: str, letter: str, a: str, b: str):
        return lambda r, i: F.array(one(kind, r[a], F.concat(F.lit(letter), i), "head"), one(kind, r[b], F.concat(F.lit(letter), i), r["relation"]))

    entities = lists("entities", lambda e: one(e["type"], e["name"], F.lit(None).cast("string"), "entity", F.coalesce(e["aliases"], none)))
    related = F.transform(without_self_relations(x), pair("Character", "r", "source", "target"))
    return F.concat(*(c.cast(f"array<{REGISTRATION}>") for c in (entities, F.flatten(lists("events", event)), F.flatten(F.coalesce(related, F.array())), F.flatten(lists("temporals", pair("Event", "t", "event_a", "event_b"))))))


REGISTRATION = "struct<kind:string,name:string,aliases:array<string>,group:string,role:string>"
PLACE = f"array<{REGISTRATION}>"


def load(extractions: DataFrame, documents: DataFrame, scopes: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, model: str = "default") -> dict[str, DataFrame | dict]:
    """Extractions (seq, window_id, body: EXTRACTION) as a graph, each name by way of the registry, in the order of seq.

    documents: (document_id, title, type, season, timeline_id), of which a window's id names one before its `#`; scopes: (id, parent) of
    timelines. ledger: (window_id, model) of windows that were loaded before, which are left out. known: the registry so far, as `entities`
    has it. Windows that the gate refuses, and those of no document, are skipped. Totals count relations and pairs as read, without those of a name with itself. Returns nodes (id, label, name, aliases, provenance), events
    (id, date, date_precision, evidence_quote), edges (src, rel, dst, provenance), entities, documents, missing, ledger, and totals.

    The gated windows are written once and counted by the same pass; one long table of registrations serves nodes and edges.
    """
    fresh = extractions if ledger is None else extractions.join(ledger.where(F.col("model") == model).select("window_id").distinct(), "window_id", "left_anti")
    about = documents.select("document_id", "title", "type", "timeline_id")
    seen = Observation()
    held = fresh.withColumn("document_id", F.when(F.contains("window_id", F.lit("#")), F.substring_index("window_id", "#", 1))).join(about, "document_id", "left")
    # Out of a generator, or the gate would be copied into every mention of it
    held = held.select("*", F.explode(F.array(F.coalesce(gate(F.col("body")), F.lit(False)) & F.col("type").isNotNull())).alias("_good"))
    size = lambda c: F.coalesce(F.sum(F.when(F.col("_good"), F.size(F.coalesce(c, F.array())))), F.lit(0))
    held = held.observe(seen, F.count(F.lit(1)).alias("windows"), F.count_if("_good").alias("chunks"), size(F.col("body.entities")).alias("entities"), size(F.col("body.events")).alias("events"), size(without_self_relations(F.col("body"))).alias("relations"), size(F.col("body.temporals")).alias("temporals"))
    made = provenance(F.col("window_id"), F.col("document_id"), F.col("title"), F.col("type"), F.col("timeline_id"))
    held = held.where("_good").select("seq", "window_id", "document_id", "timeline_id", made.alias("provenance"), registrations(F.col("body")).alias("r"), F.transform("body.events", lambda e: F.struct(e["date"].alias("date"), e["date_precision"].alias("date_precision"), e["evidence_quote"].alias("evidence_quote"))).alias("dated"))
    good = cut(held)
    totals = seen.get
    totals["skipped"] = totals.pop("windows") - totals["chunks"]
    rows = good.select(F.col("seq").alias("window"), "document_id", "timeline_id", "provenance", "dated", F.posexplode("r").alias("n", "x"))
    rows = cut(rows.select((F.col("window") * OF_WINDOW + F.col("n")).alias("seq"), "window", "document_id", "timeline_id", "provenance", "x.*", F.when((F.col("x.role") == "head") & F.col("x.group").startswith("e"), F.get("dated", F.expr("cast(substring(x.group, 2) as int)"))).alias("told")))
    outcomes, entities = register_in_order(rows.select("seq", "name", "kind", "aliases"), known)
    named = cut(rows.drop("name", "kind", "aliases").join(outcomes, "seq"))
    queued = named.groupBy(F.col("entity_id").alias("id")).agg(F.max_by("provenance", "seq").alias("provenance"))
    nodes = known_labels(queued.join(entities.withColumnRenamed("entity_id", "id"), "id").select("id", F.col("kind").alias("label"), "name", "aliases", "provenance"))
    stories = named.where("told is not null")
    events = stories.groupBy(F.col("entity_id").alias("id")).agg(F.max_by("told", "seq").alias("told")).select("id", "told.*")
    grouped = named.where("group is not null").groupBy("window", "group").agg(F.max(F.when(F.col("role") == "head", F.col("entity_id"))).alias("head"), F.collect_list(F.when(F.col("role") != "head", F.struct("seq", "role", "entity_id", "provenance"))).alias("m"))  # an event's 41 at most
    ends = grouped.select("group", "head", F.explode("m").alias("m")).select("head", F.col("m.role").alias("rel"), F.col("m.entity_id").alias("other"), F.col("m.seq").alias("seq"), F.col("m.provenance").alias("provenance"), F.left("group", F.lit(1)).alias("g"))
    to_head = (F.col("rel") == "PARTICIPATES_IN") & (F.col("g") == "e") | (F.col("rel") == "AFTER") & (F.col("g") == "t")
    ends = ends.where("g = 'e' or head <> other").select(
        "seq", F.when(to_head, F.col("other")).otherwise(F.col("head")).alias("src"), F.when((F.col("rel") == "AFTER") & (F.col("g") == "t"), "BEFORE").otherwise(F.col("rel")).alias("rel"), F.when(to_head, F.col("head")).otherwise(F.col("other")).alias("dst"), "provenance"
    )
    scoped, missing = scoped_events(stories.select(F.col("entity_id").alias("event_id"), F.concat(F.lit("timeline:"), "timeline_id").alias("scope"), "document_id"), scopes, documents.select(F.col("document_id").alias("id")))
    edges = ends.groupBy("src", "rel", "dst").agg(F.min_by("provenance", "seq").alias("provenance"))  # both ends are registered, so none dangles
    edges = edges.unionByName(scoped.withColumn("provenance", F.lit(None).cast("string")))
    shown = document_nodes(documents.withColumn("timeline_id", F.concat(F.lit("timeline:"), "timeline_id")), scopes)
    done = good.select("window_id", F.lit(model).alias("model"))
    return {"nodes": nodes, "events": events, "edges": edges, "entities": entities, "documents": shown, "missing": missing, "ledger": done, "totals": totals, "written": written(edges)}


# -- registry ------------------------------------------------------------------------------


def seeds(rows: DataFrame) -> DataFrame:
    """(entity_id, name, kind, aliases) of a seed table (name, kind, aliases); names that aren't ASCII are skipped."""
    ascii_only = rows.where(~F.col("name").rlike(r"[^\x00-\x7F]"))
    return ascii_only.select(canonical_id(F.lower("kind"), F.col("name")).alias("entity_id"), "name", "kind", "aliases")


def register_in_order(mentions: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcomes (seq, entity_id) and entities (entity_id, name, kind, aliases) of mentions (seq, name, kind, aliases), as if registered one by one.

    A mention is the entity of its own canonical id if there is one by then, else the first entity of its kind that had its name as an
    alias, else a new one. seq is a number, the order. known: entities from before, which come first, by id.

    No group is replayed. A mention can go to another entity only if some earlier mention of the kind had its name as an alias: the
    earliest such decides, whatever entity it went to itself. So a canonical id has an entity of its own from its first mention
    that no alias preceded; and the other mentions follow the earliest alias, link by link, in rounds that double their reach.
    """
    none = F.array().cast("array<string>")
    rows = mentions.select("seq", F.trim("name").alias("name"), "kind", F.coalesce("aliases", none).alias("aliases"))
    if known is not None:
        first = (rows.agg(F.min("seq")).first()[0] or 0) - 1 - known.count()
        before = known.select((F.row_number().over(W.partitionBy(F.lit(0)).orderBy("entity_id")) + first).cast("long").alias("seq"), F.trim("name").alias("name"), "kind", F.coalesce("aliases", none).alias("aliases"), F.col("entity_id").alias("id"))
        rows = rows.withColumn("id", F.lit(None).cast("string")).unionByName(before)
    else:
        rows = rows.withColumn("id", F.lit(None).cast("string"))
    rows = rows.select("seq", "name", "kind", F.lower("kind").alias("_k"), F.lower("name").alias("_key"), "aliases", F.coalesce("id", canonical_id(F.lower("kind"), F.col("name"))).alias("id"), F.col("id").isNotNull().alias("_known"))
    heard = F.when(F.col("_known"), F.concat("aliases", F.array("name"))).otherwise(F.col("aliases"))  # an id that was given need not be its name's
    aliases = rows.select("_k", F.explode(heard).alias("a"), "seq").select("_k", F.lower(F.trim("a")).alias("_key"), "seq").where("_key <> ''")
    # A name that many mentions share would bring them all to one task: what is known of names goes to the rows where it is small
    rows = rows.join(small(aliases.groupBy("_k", "_key").agg(F.min("seq").alias("at"))), ["_k", "_key"], "left")
    free = F.col("_known") | F.col("at").isNull() | (F.col("at") >= F.col("seq"))
    made = rows.where(free).groupBy("id").agg(F.min("seq").alias("made"))
    rows = cut(rows.join(small(made), "id", "left").withColumn("own", F.coalesce(F.col("made") <= F.col("seq"), F.lit(False))))
    # Names are short; a table of links has a row for each mention that an alias took
    found = rows.where("own").select("seq", F.col("id").alias("entity_id"))
    links = cut(rows.where("not own").select("seq", "at"))
    while not links.isEmpty():
        ended = links.join(found.select(F.col("seq").alias("at"), "entity_id"), "at").select("seq", "entity_id")
        ahead = links.select(F.col("seq").alias("at"), F.col("at").alias("_on"))
        links, found = cut(links.join(ended, "seq", "left_anti").join(ahead, "at").select("seq", F.col("_on").alias("at"))), cut(found.union(ended))
    held = rows.select("seq", "id", "name", "kind", "aliases", "made").join(found, "seq")
    makers = held.where("seq = made").select("entity_id", "name", "kind")
    said = held.select("entity_id", F.explode_outer("aliases").alias("a")).groupBy("entity_id").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    outcomes = found if known is None else found.join(mentions.select("seq"), "seq", "left_semi")
    return outcomes, makers.join(said, "entity_id").select("entity_id", "name", "kind", "aliases")


def merge_by_alias(mentions: DataFrame) -> DataFrame:
    """(entity_id, name, kind, aliases): mentions (seq, name, kind, aliases) of a kind that share an id or a name or alias, directly or over others.

    The first mention gives id and name; all names and aliases of the others become aliases.
    """
    named = mentions.withColumn("id", canonical_id(F.lower("kind"), F.col("name")))
    keys = named.select("id", "kind", F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("k"))
    keys = keys.select("id", F.concat_ws("\u0001", "kind", F.lower(F.trim("k"))).alias("k")).distinct()
    groups = components(keys.select("id", F.concat(F.lit("\u0002"), "k").alias("key")), "id", "key").select(F.col("node").alias("id"), "component")
    held = named.join(groups, "id")
    first = held.groupBy("component").agg(F.min_by(F.struct("id", "name", "kind"), "seq").alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")))))).alias("aliases"))
    return first.select(F.col("f.id").alias("entity_id"), "f.name", "f.kind", F.array_except("aliases", F.array("f.name")).alias("aliases"))


def record(entities: DataFrame, entity_id: str) -> dict | None:
    """One entity, or None."""
    found = entities.where(F.col("entity_id") == entity_id).first()
    return found.asDict() if found else None


# -- extraction ----------------------------------------------------------------------------


def run_extraction(windows: DataFrame, extract: Callable[[str], str]) -> DataFrame:
    """(window_id, status, body): what the extractor says of windows (window_id, text), through the gate; its failures are rows."""

    def run(frames):
        for frame in frames:
            status, body = [], []
            for text in frame["text"]:
                try:
                    body.append(extract(text))
                    status.append("ok")
                except Exception as e:  # noqa: BLE001  a window that fails doesn't stop the others
                    body.append(None)
                    status.append(f"error: {e}"[:120])
            yield frame[["window_id"]].assign(status=status, body=body)

    kind = windows.schema["window_id"].dataType.simpleString()
    said = windows.select("window_id", "text").mapInPandas(run, f"window_id {kind}, status string, body string")
    parsed = read_extraction(F.col("body"))
    bad = F.when(parsed.isNull(), "not_dict").when(~gate(parsed), "invalid")
    return said.withColumn("status", F.when(F.col("status") == "ok", F.coalesce(bad, F.lit("ok"))).otherwise(F.col("status")))


def cache_put(cache: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The cache with rows; the last of a key by `order` stays."""
    return latest(cache.unionByName(rows), keys, [F.desc(order)])


def cache_get(cache: DataFrame, body: str = "body") -> DataFrame:
    """The cache with its bodies read; what can't be read is null."""
    return cache.withColumn("read", read_extraction(F.col(body)))


def read_extraction(body: Column) -> Column:
    """A reply as a record, null unless it is a JSON object: from_json() alone would make a record of nulls."""
    return F.when(body.rlike(r"^\s*\{") & F.try_parse_json(body).isNotNull(), F.from_json(body, EXTRACTION))


def to_extract(windows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Windows without a cached success that passes the gate: failures are tried again."""
    good = cache_get(cache).where((F.col("status") == "ok") & gate(F.col("read")))
    return windows.join(good.select(*keys), keys, "left_anti")


def run_totals(run: DataFrame) -> DataFrame:
    """(status, n), errors of all kinds together."""
    return run.groupBy(F.regexp_replace("status", ":.*", "").alias("status")).agg(F.count("*").alias("n"))
