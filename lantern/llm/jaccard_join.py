"""Near-duplicate join of documents by word n-gram Jaccard, with Bayesian candidate pruning.

1. Texts with equal shingle sets are one class, represented by its smallest id.
2. Classes that share a band of their MinHash signature meet in a bucket. A bucket with the
   same members as one of a lower band is left out: its pairs are all compared there.
3. Large buckets are cut into blocks; each pair of blocks is a task of bounded size, so that
   a hot bucket is spread out and its pairs never become rows.
4. In a task, a pair is compared in its first common band only. MinHash values are compared
   a few at a time; a pair goes when the posterior probability (uniform prior) that its
   Jaccard reaches the threshold is under `tolerance`. What is left is verified exactly.
5. A task returns counts of links and a spanning forest of them, so components need no pairs.

Nulls, empty texts and texts without words have no shingles and link with nothing. Texts of 1
to n-1 words have one shingle. A row whose id is null links with nothing and has no class. Ids
may repeat: there is one result row for each input row, by its own text. Other columns of the
input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS = 24, 4
#: Classes in a block; a task compares two blocks.
BLOCK = 512


def posterior(threshold: float, matches: int, seen: int) -> float:
    """P(similarity >= threshold | matches of seen MinHash values agree), uniform prior."""
    n = seen + 1  # 1 - I_t(m+1, n-m) as a binomial sum
    return sum(math.comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(matches + 1))


def least_matches(threshold: float, tolerance: float, size: int, step: int) -> list[tuple[int, int]]:
    """(values compared, least matches that keep a pair) for each step."""
    return [(n, next(m for m in range(n + 1) if posterior(threshold, m, n) >= tolerance)) for n in range(step, size + 1, step)]


def _signer(n: int):
    def sign(batches):
        for batch in batches:
            ids, names, texts = batch.column("id"), batch.column("name"), batch.column("text").to_pylist()
            for a, b in C.chunks(texts):
                docs, hashes = C.shingles(texts[a:b], n)
                count = np.bincount(docs, minlength=b - a)
                has = count > 0
                two = []
                for salt in (3, 5):  # 128 bits that name the set
                    total = np.zeros(b - a, dtype=np.uint64)
                    np.add.at(total, docs, C.mix(hashes + np.uint64(salt)))
                    two.append(total.view(np.int64))
                bands = C.band_keys(C.minhash(docs, hashes, b - a, BANDS * ROWS), ROWS)
                flat = pa.array(bands[has].ravel())
                where = pa.array(np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32))
                none = pa.array(~has)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), names.slice(a, b - a), pa.array(two[0], mask=~has), pa.array(two[1], mask=~has), pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(where, flat, mask=none),
                ], names=["id", "name", "k1", "k2", "n", "bands"])
        C.trim()

    return sign


def _shingler(n: int):
    def make(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in C.chunks(texts):
                docs, hashes = C.shingles(texts[a:b], n)
                docs_n = np.bincount(docs, minlength=b - a)
                signature = C.minhash(docs, hashes, b - a, BANDS * ROWS)
                name = np.zeros(b - a, dtype=np.uint64)
                np.add.at(name, docs, C.mix(hashes + np.uint64(3)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(name.view(np.int64)), batch.column("node").slice(a, b - a), batch.column("copies").slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(docs_n)]).astype(np.int32)), pa.array(hashes.view(np.int64))),
                    pa.array([x.tobytes() for x in signature], pa.binary()), pa.array([x.tobytes() for x in C.band_keys(signature, ROWS)], pa.binary()),
                ], names=["own", "node", "copies", "grams", "signature", "keys"])
        C.trim()

    return make


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exactly, by blocks of columns."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 8192
    for a in range(0, int(column[-1]) + 1 if column.size else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((n, width), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _comparer(threshold: float, tolerance: float, step: int):
    plan = least_matches(threshold, tolerance, BANDS * ROWS, step)

    def compare(key, tbl):
        band, first, second = (key[k].as_py() for k in (1, 2, 3))
        tbl = tbl.take(pc.sort_indices(tbl, sort_keys=[("block", "ascending"), ("node", "ascending")]))
        nodes, copies, block = (tbl.column(c).to_numpy() for c in ("node", "copies", "block"))
        keys = np.frombuffer(b"".join(tbl.column("keys").to_pylist()), dtype=np.int64).reshape(-1, BANDS)
        signature = np.frombuffer(b"".join(tbl.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, BANDS * ROWS)
        grams = tbl.column("grams")
        sets = [grams[i].values.to_numpy() for i in range(len(nodes))]
        left = np.flatnonzero(block == first)
        right = np.flatnonzero(block == second)
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        if first == second:
            i, j = i[i < j], j[i < j]
        earlier = np.zeros(i.size, dtype=bool)
        for b in range(band):
            earlier |= keys[i, b] == keys[j, b]
        i, j = i[~earlier], j[~earlier]
        seen, matches = 0, np.zeros(i.size, dtype=np.int32)
        for upto, least in plan:
            matches = matches + (signature[i, seen:upto] == signature[j, seen:upto]).sum(1, dtype=np.int32)
            keep = matches >= least
            i, j, matches, seen = i[keep], j[keep], matches[keep], upto
        if i.size:
            used = np.unique(np.concatenate([i, j]))
            at = np.zeros(len(nodes), dtype=np.int64)
            at[used] = np.arange(used.size)
            size = np.array([s.size for s in sets])
            both = overlaps([sets[x] for x in used])[at[i], at[j]]
            keep = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[keep], j[keep]
        links = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = C.star_edges(len(nodes), i, j)
        out = links > 0
        return pa.table({"node": nodes[out], "links": links[out], "to": nodes[root[out]]})

    return compare


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7, step: int = 16) -> DataFrame:
    """(id, class_id, n_links, kept, text_key, group_key): the smallest id of each group, links to other rows, id = class_id.

    text_key is the text's xxhash64; group_key tells groups apart even where ids repeat, and is null for rows without words or id.
    """
    texts = C.small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("name"), F.col(text_col).alias("text"))
    signed = C.cut(texts.mapInArrow(_signer(n), "id long, name long, k1 long, k2 long, n int, bands array<long>"))
    # Equal sets have equal k1 and k2; k1 names the class from here on.
    classes = C.cut(
        signed.where("n > 0 and id is not null").groupBy("k1", "k2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("bands").alias("bands")).withColumnRenamed("k1", "node")
    )
    rows = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = (
        rows.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.min("node").alias("least")).where("size > 1")
        .groupBy("size", "members", "least").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key", "size")
    )
    met = C.cut(
        rows.join(buckets, ["band", "key"])
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
        .select("node", "band", "key", "block", "blocks")
    )
    wanted = classes.join(met.select("node").distinct(), "node", "left_semi").select("rep", "node", "copies")
    if wanted.count() <= 1_000_000:  # 24 bytes each
        wanted = F.broadcast(wanted)
    sources = texts.drop("name").join(wanted, texts["id"] == wanted["rep"]).select("node", "copies", "text")
    grams = (
        sources.mapInArrow(_shingler(n), "own long, node long, copies long, grams array<long>, signature binary, keys binary")
        .where("own = node").drop("own").dropDuplicates(["node"])
    )
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "band", "key", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    )
    compared = pairs.join(grams, "node").groupBy("key", "band", "first", "second").applyInArrow(_comparer(threshold, tolerance, step), "node long, links long, to long")
    compared = C.cut(compared)
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    groups = C.components(compared, "node", "to")
    smallest = groups.join(classes, "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    found = classes.select("node", "k2", "rep", "copies").join(links, "node", "left").join(groups.join(smallest, "component"), "node", "left")
    found = found.select(F.col("node").alias("k1"), "k2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group_key"))
    named = signed.where("n > 0 and id is not null").select("id", "name", "k1", "k2").join(found, ["k1", "k2"]).select("id", "name", "class_id", "n_links", "group_key")
    alone = signed.where("n = 0 or id is null").select("id", "name", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group_key"))
    return named.union(alone).select(F.col("id").alias(id_col), "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"), F.col("name").alias("text_key"), "group_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group: with the smallest id, and of that with the smallest text key.

    Rows without links stay, all of them; so those without an id or without words.
    """
    found = C.cut(jaccard_join(docs, id_col, text_col).where("n_links > 0").select(F.col(id_col).cast("long").alias("id"), F.col("text_key").alias("key"), F.col("group_key").alias("group")))
    one = found.groupBy("group").agg(F.min(F.struct("id", "key")).alias("one"))
    held = C.cut(found.groupBy("group", "id", "key").agg(F.count("*").alias("n")).join(one, "group").select("id", "key", "n", ((F.col("id") == F.col("one.id")) & (F.col("key") == F.col("one.key"))).alias("first")))
    gone = held.where("not first").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    again = held.where("first and n > 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"))
    few = held.count() <= 1_000_000  # 16 bytes each
    small = lambda df: F.broadcast(df) if few else df
    kept = keyed.join(small(gone), ["_id", "_key"], "left_anti")
    if not again.isEmpty():  # equal rows
        once = kept.join(small(again), ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
        kept = kept.join(small(again), ["_id", "_key"], "left_anti").unionByName(once)
    return kept.select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
found AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
links AS (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links, doc_id = class_id AS kept FROM documents JOIN classes ON classes.a = doc_id LEFT JOIN degree ON degree.a = doc_id
"""
