"""Property-graph operators on node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.plans.lineage import cut

# Order of labels among candidates; others come last, as 9.
LABEL_RANK = {"Character": 0, "Object": 1, "Organization": 2, "Location": 3, "Event": 4, "Series": 5, "Movie": 6, "Episode": 7, "Timeline": 8}


def label_rank(label: Column, ranks: dict[str, int] = LABEL_RANK) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), label), F.lit(9))


def small(few: DataFrame, most: int = 100_000) -> DataFrame:
    """few, written, and broadcast if it has `most` rows or less."""
    held = cut(few)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("other")).union(edges.select(F.col("dst").alias("id"), "rel", F.col("src").alias("other")))


def neighbours(found: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """found with `neighbours`: up to `most` (other, rel), smallest first; empty without any."""
    near = undirected(edges).join(small(found.select("id").distinct()), "id", "left_semi").distinct()
    kept = near.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("other", "rel"))).where(F.col("_n") <= most)
    lists = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "rel"))).alias("neighbours"))
    return found.join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<struct<other:string,rel:string>>")))


# Relations by which something bears witness to a scope, and how each kind of witness is in a scope.
WITNESSED_BY = ["PARTICIPATES_IN", "INVOLVES", "OCCURS_AT"]
IN_SCOPE = {"Event": "OCCURS_IN", "Movie": "DEPICTED_IN", "Episode": "DEPICTED_IN"}


def witnesses(candidates: DataFrame, edges: DataFrame, nodes: DataFrame, scope: str) -> DataFrame:
    """Candidates that take part in, are involved in or are the place of an event, movie or episode of the scope. nodes: (id, label)."""
    ways = F.create_map(*[F.lit(x) for kv in IN_SCOPE.items() for x in kv])
    inside = edges.where((F.col("dst") == scope) & F.col("rel").isin(*set(IN_SCOPE.values()))).select(F.col("src").alias("id"), "rel")
    told = nodes.where(F.col("label").isin(*IN_SCOPE)).join(inside, "id").where(F.try_element_at(ways, F.col("label")) == F.col("rel")).select(F.col("id").alias("other")).distinct()
    touching = undirected(edges.where(F.col("rel").isin(WITNESSED_BY))).join(told, "other", "left_semi").select("id")
    return candidates.join(touching, "id", "left_semi")


def walk(edges: DataFrame, starts: DataFrame, hops: int = 3, backward: bool = False) -> DataFrame:
    """(start, node, hop): nodes 1 to `hops` steps from the starts, at the least number of steps.

    A node is gone on from once for each start, at its first step.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("_next")).distinct()
    front, out = starts.select(F.col("id").alias("start"), F.col("id").alias("node")), None
    for hop in range(1, hops + 1):
        front = front.join(step, "node").select("start", F.col("_next").alias("node")).distinct()
        if out is not None:
            front = front.join(out, ["start", "node"], "left_anti")
        front = cut(front) if hop < hops else front
        reached = front.withColumn("hop", F.lit(hop))
        out = reached if out is None else out.union(reached)
    return out


def _level(front: DataFrame, seen: DataFrame, step: DataFrame, side: str) -> DataFrame:
    grown = front.join(step, "node").select("a", "b", F.col("_next").alias("node"), (F.concat("path", F.array("_next")) if side == "a" else F.concat(F.array("_next"), F.col("path"))).alias("path"))
    return cut(grown.join(seen.select("a", "b", "node"), ["a", "b", "node"], "left_anti").groupBy("a", "b", "node").agg(F.min("path").alias("path")))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 5) -> DataFrame:
    """(a, b, hops, path): the first of the shortest undirected paths of each pair, by the order of its nodes.

    Levels grow from both ends in turn, so that each goes half the way; a level holds each node once
    for each pair, with its first path. Pairs that have met go no further. pairs: a question's few endpoint pairs.
    """
    step = undirected(edges).select(F.col("id").alias("node"), F.col("other").alias("_next")).distinct()
    own = pairs.select("a", "b").distinct()
    left = own.select("a", "b", F.col("a").alias("node"), F.array("a").alias("path"))
    right = own.select("a", "b", F.col("b").alias("node"), F.array("b").alias("path"))
    seen_l, seen_r = left, right
    out = left.where("a = b").select("a", "b", F.lit(0).alias("hops"), "path")
    for hop in range(1, hops + 1):
        open_pairs = own.join(out.select("a", "b"), ["a", "b"], "left_anti")
        if hop % 2:
            left = _level(left.join(open_pairs, ["a", "b"], "left_semi"), seen_l, step, "a")
            seen_l = seen_l.union(left)
        else:
            right = _level(right.join(open_pairs, ["a", "b"], "left_semi"), seen_r, step, "b")
            seen_r = seen_r.union(right)
        met = left.join(right.select("a", "b", "node", F.col("path").alias("rest")), ["a", "b", "node"]).join(open_pairs, ["a", "b"], "left_semi")
        whole = F.concat("path", F.slice("rest", 2, F.size("rest")))
        out = cut(out.union(met.groupBy("a", "b").agg(F.min(whole).alias("path")).select("a", "b", F.lit(hop).alias("hops"), "path")))
    return out


def endpoint_candidates(nodes: DataFrame, name: str, tokens: list[str], ranks: dict[str, int] = LABEL_RANK, most: int = 3) -> DataFrame:
    """Nodes for one end of a connection: names that contain it or that it contains, else names that hold some of its tokens."""
    low = F.lower("name")
    both = F.contains(low, F.lit(name.lower())) | F.contains(F.lit(name.lower()), low)
    hits = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(low, t)) if tokens else F.array().cast("array<string>")
    scored = nodes.withColumn("_tier", F.when(both, 0).when(F.size(hits) > 0, 1)).where("_tier is not null").withColumn("_hits", F.size(hits))
    best = scored.crossJoin(F.broadcast(scored.agg(F.min("_tier").alias("_best")))).where("_tier = _best")
    order = [label_rank(F.col("label"), ranks), F.when(F.col("_tier") == 0, F.abs(F.length("name") - len(name))).otherwise(-F.col("_hits")), F.col("id")]
    return best.orderBy(*order).limit(most).select("id", "name", "label", F.col("_hits").alias("hits"))


def scope_tree(scopes: DataFrame) -> DataFrame:
    """(id, name, parent_name) of scopes (id, name, parent)."""
    up = scopes.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return scopes.join(up, "parent", "left").select("id", "name", "parent_name")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over edges, for every node on an edge.

    Alternates large-star and small-star steps, which needs O(log n) rounds even for
    chains; every round is written to the checkpoint folder. Edges stay distributed.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs)
    last = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = cut(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.union(roots).groupBy("node").agg(F.min("component").alias("component"))
