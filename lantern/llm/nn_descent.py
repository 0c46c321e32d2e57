"""Embedding near-duplicates by NN-descent.

1. Equal vectors of a label are one node. Nodes meet first in buckets of random hyperplane
   signs, deep enough for the label's size; the nearest in a bucket start their lists.
2. NN-descent: the list of a node and those it stands in form its neighbourhood; each
   neighbourhood is joined with itself and lists keep the nearest. Rounds go on until hardly any
   list changes.
3. Edges are verified in double precision and those under the threshold dropped. A list that is
   full of links is saturated: there may be more than it has room for. The lists of all
   nodes linked with such a node, directly or not, are enlarged to hold them all: their
   component is compared exactly, in pairs of blocks of bounded size.
4. Recall is audited: up to `audit` nodes, half of them with links and half chosen from all, by hash, are
   compared with all nodes. Under `target`, everything is done again with twice the tables and
   lists; after LAST tables, the nodes of each label are compared exactly, in pairs of blocks.

`recall` is what the last audit found, 1 where there was nothing to find.

Vectors link only if their labels (and dimensions) are equal and not null. Null, zero and empty
vectors and vectors with null, infinite or NaN components link with nothing, and so do rows
with a null id. Ids may repeat: there is one result row for each input row; rows of one id
count as one vector for each distinct embedding. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 24
#: Nodes of a bucket or block that meet in one task; average size of a bucket; nodes joined in one call.
MEET, BUCKET, BATCH = 256, 64, 1024
#: Nodes of a block of an exact comparison; tables after which the descent is given up.
BLOCK, LAST = 2048, 64
EDGE = "src long, dst long, sim double"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _best(ids: np.ndarray, sims: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Up to k nearest others of each row, over its floor."""
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, int), np.zeros(0, int)
    np.fill_diagonal(sims, -2)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(ids)), k)
    at = at.ravel()
    keep = sims[row, at] > (-1 if floor is None else floor[row])
    return row[keep], at[keep]


def _edges(src, dst, sim) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _signs(tables: int):
    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("unit").to_pylist():
                v = np.asarray(v, dtype=np.float64)
                planes = np.random.default_rng(97 * len(v)).standard_normal((tables * BITS, len(v))) if not out or planes.shape[1] != len(v) else planes
                bits = (planes @ v > 0).reshape(tables, BITS)
                out.append((bits @ (1 << np.arange(BITS - 1, -1, -1))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("space"), pa.array(out, pa.list_(pa.int32()))], names=["node", "space", "signs"])

    return run


def _meet(k: int):
    def run(tbl):
        ids, x = tbl.column("node").to_numpy(), _matrix(tbl.column("small")).astype(np.float32)
        sims = x @ x.T
        i, j = _best(ids, sims, k)
        return _edges(ids[i], ids[j], sims[i, j])

    return run


def _local_join(k: int):
    """Neighbourhoods of a batch of nodes: rows (at, node, floor, small)."""

    def run(tbl):
        tbl = tbl.sort_by([("at", "ascending"), ("node", "ascending")])
        at, ids, floor = (tbl.column(c).to_numpy() for c in ("at", "node", "floor"))
        x = _matrix(tbl.column("small")).astype(np.float32)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        src, dst, sim = [], [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            sims = x[a:b] @ x[a:b].T
            i, j = _best(ids[a:b], sims, k, floor[a:b])
            src.append(ids[a:b][i])
            dst.append(ids[a:b][j])
            sim.append(sims[i, j])
        if not src:
            return _edges([], [], [])
        s, d, v = np.concatenate(src), np.concatenate(dst), np.concatenate(sim)
        order = np.lexsort((d, s))
        s, d, v = s[order], d[order], v[order]
        fresh = np.ones(s.size, bool)
        fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        return _edges(s[fresh], d[fresh], v[fresh])

    return run


def _exact(threshold: float):
    def run(key, tbl):
        first, second = key[1].as_py(), key[2].as_py()
        ids, copies, block, x = tbl.column("node").to_numpy(), tbl.column("copies").to_numpy(), tbl.column("block").to_numpy(), _matrix(tbl.column("unit"))
        links = np.zeros(len(ids), dtype=np.int64)
        l, r = np.flatnonzero(block == first), np.flatnonzero(block == second)
        hit = x[l] @ x[r].T >= threshold
        if first == second:
            np.fill_diagonal(hit, False)
        links[l] += hit @ copies[r]
        if first != second:
            links[r] += hit.T @ copies[l]
        i, j = np.nonzero(hit)
        root = C.star_edges(len(ids), l[i], r[j])
        return pa.table({"node": ids, "links": links, "to": ids[root]})

    return run


def exact(inside: DataFrame, threshold: float) -> DataFrame:
    """(node, links, to): links of the nodes of each group among themselves, and a spanning forest. inside: (component, node, copies, unit)."""
    blocks = inside.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = inside.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", "node", "copies", "unit", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return dealt.groupBy("component", "first", "second").applyInArrow(_exact(threshold), "node long, links long, to long")


def _audit(ids: np.ndarray, spaces: list[str], units: list[np.ndarray], threshold: float):
    def run(batches):
        for batch in batches:
            space, copies = np.array(batch.column("space").to_pylist()), batch.column("copies").to_numpy()
            nodes, units_here = batch.column("node").to_numpy(), batch.column("unit")
            out = np.zeros(len(ids), dtype=np.int64)
            for s in set(spaces):
                rows = np.flatnonzero(space == s)
                if rows.size:
                    x = _matrix(units_here.take(pa.array(rows)))
                    for q in (q for q, own in enumerate(spaces) if own == s):
                        out[q] += copies[rows][(x @ units[q] >= threshold) & (nodes[rows] != ids[q])].sum()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], names=["node", "true"])

    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node: (src, dst, sim)."""
    best = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim")).groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "dst"))), 1, k).alias("list"))
    return best.select("src", F.explode("list").alias("e")).select("src", F.col("e.dst").alias("dst"), (-F.col("e.far")).alias("sim"))


def neighbour_graph(nodes: DataFrame, k: int, tables: int, rounds: int, settled: float) -> DataFrame:
    """Lists of NN-descent, as edges (src, dst, sim)."""
    count = nodes.count()
    small = nodes.select("node", F.transform("unit", lambda x: x.cast("float")).alias("small"))
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n"))
    depth = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / BUCKET)))).cast("int")
    signs = nodes.mapInArrow(_signs(tables), "node long, space string, signs array<int>").join(sizes.select("space", depth.alias("depth")), "space")
    keys = signs.select("node", "space", F.posexplode("signs").alias("t", "sign"), "depth").withColumn("bucket", F.expr(f"shiftright(sign, {BITS} - depth)")).drop("sign", "depth")
    parts = keys.groupBy("space", "t", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("space", "t", "bucket", F.ceil(F.col("n") / MEET).cast("int").alias("parts"))
    placed = keys.join(parts, ["space", "t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")).cast("int")).drop("parts")
    graph = C.cut(_nearest(placed.join(small, "node").groupBy("space", "t", "bucket", "part").applyInArrow(_meet(k), EDGE), k))
    batches = max(1, -(-count // BATCH))
    for _ in range(rounds):
        floor = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-1.0)).alias("floor")).withColumnRenamed("src", "node")
        # Those a node stands in the lists of: as many as its own list, chosen by hash.
        into = graph.groupBy(F.col("dst").alias("at")).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("src", "dst").alias("h"), "src"))), 1, k).alias("l"))
        near = graph.select(F.col("src").alias("at"), F.col("dst").alias("node")).union(into.select("at", F.explode("l.src").alias("node"))).union(nodes.select(F.col("node").alias("at"), "node")).distinct()
        joined = near.join(small, "node").join(floor, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
        found = joined.groupBy(F.pmod(F.xxhash64("at"), F.lit(batches))).applyInArrow(_local_join(k), EDGE)
        better = C.cut(_nearest(graph.union(found), k))
        changed = better.join(graph, ["src", "dst"], "left_anti").count()
        graph = better
        if changed <= settled * count * k:
            break
    return graph


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, k: int = 10, tables: int = 8, rounds: int = 4, settled: float = 0.002, audit: int = 256, target: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept, recall) of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Divided by its largest component first, so that squares neither overflow nor vanish.
    rows = rows.withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x))))
    rows = rows.withColumn("u", F.when((F.col("top") > 0) & (F.col("top") < float("inf")), F.transform("v", lambda x: x / F.col("top"))))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    valid = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad).cast("boolean")
    rows = rows.withColumn("norm", F.when(valid, norm)).withColumn("good", F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False)))
    rows = rows.withColumn("space", F.concat_ws(" ", F.size("v"), "label")).withColumn("name", F.md5(F.concat_ws(" ", F.array(F.col("space")), F.transform("v", lambda x: F.hex(x.cast("string"))))))
    rows = C.cut(rows.select("id", "good", "space", F.when(F.col("good"), F.transform("u", lambda x: x / F.col("norm"))).alias("unit"), "name"))
    nodes = C.cut(rows.where("good").groupBy("space", "name").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit")).drop("name"))
    while True:
        graph = neighbour_graph(nodes, k, tables, rounds, settled)
        unit = nodes.select(F.col("node"), "unit")
        close = graph.where(F.col("sim") >= threshold - 1e-3).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        pair = close.join(unit.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a").join(unit.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b")
        cosine = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        links = C.cut(pair.where(cosine >= threshold).select("a", "b"))
        groups = C.cut(C.components(links))
        full = graph.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("sim").alias("least")).where((F.col("n") >= k) & (F.col("least") >= threshold - 1e-3))
        dense = groups.join(full, "node", "left_semi").select("component").distinct()
        inside = groups.join(dense, "component", "left_semi").join(nodes, "node")
        enlarged = exact(inside.select("component", "node", "copies", "unit"), threshold).select("node", "links")
        sparse = links.join(groups.join(dense, "component", "left_anti").select(F.col("node").alias("a")), "a", "left_semi")
        both = sparse.union(sparse.select(F.col("b").alias("a"), F.col("a").alias("b")))
        single = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("links"))
        degree = C.cut(enlarged.union(single).groupBy("node").agg(F.sum("links").alias("links")))
        order = [F.xxhash64("node", F.lit(3)), F.col("node")]
        linked = nodes.join(degree.where("links > 0"), "node", "left_semi").orderBy(*order).limit(audit // 2)
        chosen = linked.unionByName(nodes.orderBy(*order).limit(audit - audit // 2)).dropDuplicates(["node"]).orderBy("node").collect()  # audit rows
        recall = 1.0
        if not chosen:
            break
        check = _audit(np.array([r["node"] for r in chosen]), [r["space"] for r in chosen], [np.array(r["unit"]) for r in chosen], threshold)
        true = nodes.mapInArrow(check, "node long, true long").groupBy("node").agg(F.sum("true").alias("true")).join(degree, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()
        recall = true[1] / true[0] if true[0] else 1.0
        if recall >= target:
            break
        if 2 * tables > LAST:
            whole = C.cut(exact(nodes.select(F.col("space").alias("component"), "node", "copies", "unit"), threshold))
            degree, groups, recall = whole.groupBy("node").agg(F.sum("links").alias("links")), C.cut(C.components(whole, "node", "to")), 1.0
            break
        k, tables = 2 * k, 2 * tables
    label = groups.join(nodes.select("node"), "node").select("node", "component")
    known = nodes.select("node", "copies").join(degree, "node", "left").join(label, "node", "left")
    known = known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = rows.where("good").select("id", "space", "name")
    twins = named.groupBy("space", "name").agg(F.min("id").alias("node"))
    found = named.join(twins, ["space", "name"]).join(known, "node").select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON component.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""
