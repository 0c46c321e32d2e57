"""An inverted index that can be updated: segments of posting blocks, lists of replaced documents, merging.

Under a folder, each a Parquet table with a part for each segment:

blocks     term, no, max_tf, min_dl and, as arrays of up to BLOCK postings each, ids, tfs, dls, scopes, positions; by bucket of the term
documents  id, dl, scope of the segment's documents
replaced   ids of earlier segments' documents that this segment replaces or deletes
totals     what the segment adds to the numbers of documents and of terms, its buckets, one row

A search reads the buckets of its terms, and of these the terms' rows. For ranked questions of single terms it reads the
blocks' bounds first and then only those blocks that can hold a document of the best k. Replaced
postings are left out by an anti-join and don't count in statistics. A segment has as many buckets as
its size asks for. `merge` writes all live postings anew as one segment, without the texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lantern.functions.text import terms
from lantern.operators.lexical import phrases_of
from lantern.plans.lineage import cut, scratch

#: Postings of a block, and of a bucket of terms, about.
BLOCK, BUCKET = 128, 4_000_000
K1, B = 1.2, 0.75
#: Terms, about, whose postings are gathered at once.
SLICE = 1_000_000
FRAGMENT = "term string, scope string, ids array<long>, tfs array<int>, dls array<int>, flat array<int>"
#: Replaced documents that go to every task of a merge; more are left out by a join.
REPLACED = 4_000_000
BLOCKS = "bucket int, term string, no long, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>, scopes array<string>, positions array<array<int>>"


def _tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    kinds = {"blocks": "term string, no long, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>, scopes array<string>, positions array<array<int>>, segment int, bucket int", "documents": "id long, dl int, scope string, segment int", "replaced": "id long, segment int", "totals": "n long, length long, buckets int, segment int"}
    return {k: spark.read.schema(s).parquet(f"{path}/{k}") for k, s in kinds.items()}


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    from py4j.protocol import Py4JJavaError

    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    except Py4JJavaError:
        return False


def _fragments(half: int):
    """Postings of whole documents, gathered within a slice of an Arrow batch: rows as FRAGMENT has them, of `half` postings at most.

    A row without a term lists the slice's documents. Positions of all postings of a row stand in one list, tfs apart.
    """

    def run(batches):
        for batch in batches:
            dl = pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(dl) // SLICE)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(dl)], strict=True):
                if b > a:
                    yield _fragment(batch.slice(a, b - a), dl[a:b], half)

    return run


def _fragment(rows: pa.RecordBatch, dl: np.ndarray, half: int) -> pa.RecordBatch:
    scope = pc.fill_null(rows.column("scope").dictionary_encode().indices, -1).to_numpy()
    by = np.argsort(scope, kind="stable")
    rows, dl, scope, n = rows.take(pa.array(by)), dl[by], scope[by], len(dl)
    words = rows.column("w").flatten().dictionary_encode()
    key = words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl)
    order = np.argsort(key, kind="stable")  # by term, then scope and document, then position
    position = (np.arange(len(key)) - np.repeat(np.cumsum(dl) - dl, dl))[order]
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # where a posting begins
    code, row = np.divmod(key[first], n)
    none = len(words.dictionary)  # stands for no term: a row for each document
    code, row, tf = np.append(code, np.full(n, none)), np.append(row, np.arange(n)), np.append(np.diff(first, append=len(key)), np.zeros(n, np.int64))
    own = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(scope[row], prepend=-2) != 0))  # where a term's scope begins
    begin = np.flatnonzero((np.arange(len(code)) - np.repeat(own, np.diff(own, append=len(code)))) % half == 0)
    wide = pa.array(np.append(begin, len(code)), pa.int32())
    spots = pa.array(np.append(0, np.cumsum(tf))[wide], pa.int32())
    lists = lambda x, kind: pa.ListArray.from_arrays(wide, pa.array(x, kind))
    names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    columns = [names.take(pa.array(code[begin])), rows.column("scope").take(pa.array(row[begin])), lists(rows.column("id").to_numpy()[row], pa.int64()), lists(tf, pa.int32()), lists(dl[row], pa.int32()), pa.ListArray.from_arrays(spots, pa.array(position, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["term", "scope", "ids", "tfs", "dls", "flat"])


def _living(dead: Broadcast):
    """Blocks without the postings of documents that a later segment replaced, as fragments of one scope each. dead: ids in order, and their last replacing segments."""

    def run(batches):
        gone, later = dead.value
        for batch in batches:
            flat = lambda c: batch.column(c).flatten()
            size = pc.list_value_length(batch.column("ids")).to_numpy()
            ids, tfs = flat("ids").to_numpy(), flat("tfs").to_numpy()
            at = np.minimum(np.searchsorted(gone, ids), max(len(gone) - 1, 0))
            live = np.full(len(ids), True) if not len(gone) else (gone[at] != ids) | (later[at] <= np.repeat(batch.column("segment").to_numpy(), size))
            keep = pa.array(live)
            row, held = np.repeat(np.arange(len(size)), size)[live], flat("scopes").filter(keep)
            scope = pc.fill_null(held.dictionary_encode().indices, -1).to_numpy()
            begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(scope, prepend=-2) != 0))
            wide = pa.array(np.append(begin, len(row)), pa.int32())
            spots = pa.array(np.append(0, np.cumsum(tfs[live]))[wide], pa.int32())
            positions = flat("positions").flatten().filter(pa.array(np.repeat(live, tfs)))
            lists = lambda c: pa.ListArray.from_arrays(wide, flat(c).filter(keep))
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(row[begin])), held.take(pa.array(begin)), lists("ids"), lists("tfs"), lists("dls"), pa.ListArray.from_arrays(spots, positions)], names=["term", "scope", "ids", "tfs", "dls", "flat"])

    return run


def _blocks(half: int):
    """Rows of a term that follow each other, joined to blocks of BLOCK postings at most; `no` stands once in a segment and term."""

    def run(batches):
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = pc.list_value_length(batch.column("ids")).to_numpy().astype(np.int64)
            term = batch.column("term")
            starts = np.flatnonzero(np.append(True, pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)))
            before = np.cumsum(size) - size
            held = (before - np.repeat(before[starts], np.diff(starts, append=n))) // half
            fresh = np.zeros(n, bool)
            fresh[starts] = True
            fresh |= size > half  # a block from before stays one
            fresh[1:] |= size[:-1] > half
            begin = np.flatnonzero(fresh | (np.diff(held, prepend=0) != 0))
            at = np.append(before, size.sum())[np.append(begin, n)]
            tfs = batch.column("tfs").flatten().to_numpy()
            lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
            flat = lambda c: batch.column(c).flatten()
            spots = pa.array(np.append(0, np.cumsum(tfs)), pa.int32())
            positions = pa.ListArray.from_arrays(spots, flat("flat"))
            columns = [batch.column("bucket").take(pa.array(begin)), term.take(pa.array(begin)), pa.array(no + np.arange(len(begin)), pa.int64())]
            columns += [pa.array(np.maximum.reduceat(tfs, at[:-1]), pa.int32()), pa.array(np.minimum.reduceat(flat("dls").to_numpy(), at[:-1]), pa.int32())]
            columns += [lists(flat("ids")), lists(flat("tfs")), lists(flat("dls")), lists(batch.column("scope").take(pa.array(np.repeat(np.arange(n), size)))), lists(positions)]
            no += len(begin)
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "term", "no", "max_tf", "min_dl", "ids", "tfs", "dls", "scopes", "positions"])

    return run


def _read_once(docs: DataFrame, id_col: str, text_col: str, scope: Column | None) -> tuple[DataFrame, DataFrame]:
    """Fragments and documents (id, dl, scope) of docs, whose texts are read once: the fragments are written."""
    spark = docs.sparkSession
    held = docs.select(F.col(id_col).cast("long").alias("id"), (scope if scope is not None else F.lit(None)).cast("string").alias("scope"), terms(F.col(text_col)).alias("w"))
    written = scratch(spark, "postings")
    held.mapInArrow(_fragments(max(1, BLOCK // 2)), FRAGMENT).write.parquet(written)
    rows = spark.read.schema(FRAGMENT).parquet(written)
    documents = rows.where("term is null").select("scope", F.explode(F.arrays_zip("ids", "dls")).alias("d"))
    return rows.where("term is not null"), documents.select(F.col("d.ids").alias("id"), F.col("d.dls").alias("dl"), "scope")


def _write(spark: SparkSession, path: str, segment: int, fragments: DataFrame, documents: DataFrame, replaced: DataFrame | None, less: tuple[int, int]) -> None:
    """One segment. less: documents, and their terms, that are no longer counted."""
    n, length = documents.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    buckets = max(1, -(-length // BUCKET))
    # A bucket's terms in four parts, which Spark splits further where a hot term makes one large: blocks may end anywhere
    dealt = fragments.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("_first", F.col("ids")[0])
    dealt = dealt.withColumn("_part", F.pmod(F.hash("term"), F.lit(4))).hint("rebalance", "bucket", "_part").drop("_part")
    blocks = dealt.sortWithinPartitions("bucket", "term", "_first").drop("_first").mapInArrow(_blocks(max(1, BLOCK // 2)), BLOCKS)
    blocks = blocks.withColumn("segment", F.lit(segment))
    blocks.sortWithinPartitions("bucket", "term", "no").write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/blocks")
    documents.select("id", "dl", "scope", F.lit(segment).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{path}/documents")
    (replaced if replaced is not None else documents.select("id").limit(0)).select("id", F.lit(segment).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{path}/replaced")
    # Written last: a segment without totals doesn't exist
    spark.createDataFrame([(n - less[0], length - less[1], buckets, segment)], "n long, length long, buckets int, segment int").write.mode("append").partitionBy("segment").parquet(f"{path}/totals")


def update(docs: DataFrame, path: str, id_col: str, text_col: str = "text", scope: Column | None = None, deleted: DataFrame | None = None) -> int:
    """Add docs to the index, in place of the documents of their ids, and delete those of deleted (id). The number of the segment.

    The first update makes the index. Ids are not null and stand once in docs; texts may be null or empty.
    """
    spark = docs.sparkSession
    fragments, sized = _read_once(docs, id_col, text_col, scope)
    segment, replaced, less = 0, None, (0, 0)
    if _exists(spark, path):
        held = _tables(spark, path)
        segment = held["totals"].agg(F.max("segment")).first()[0] + 1
        gone = sized.select("id") if deleted is None else sized.select("id").union(deleted.select(F.col(deleted.columns[0]).cast("long")))
        replaced = cut(_live(held).join(gone.distinct(), "id", "left_semi"))
        less = tuple(replaced.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())
    _write(spark, path, segment, fragments, sized, replaced, less)
    return segment


def _live(held: dict[str, DataFrame]) -> DataFrame:
    """(id, dl, scope, segment) of the documents that nothing replaced."""
    return _without_replaced(_known(held, "documents"), held)


def _known(held: dict[str, DataFrame], table: str) -> DataFrame:
    """Rows of whole segments."""
    return held[table].join(F.broadcast(held["totals"].select("segment")), "segment", "left_semi")  # one row for each segment


def _later(held: dict[str, DataFrame]) -> DataFrame:
    """(_id, _later): documents that were replaced, and the last segment that did so."""
    return _known(held, "replaced").groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("_later"))


def _without_replaced(rows: DataFrame, held: dict[str, DataFrame]) -> DataFrame:
    return rows.join(_later(held), (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_later")), "left_anti")


def merge(spark: SparkSession, path: str, into: str) -> None:
    """All live postings as one segment of a new index."""
    held = _tables(spark, path)
    blocks = _known(held, "blocks").select("segment", "term", "ids", "tfs", "dls", "scopes", "positions")
    dead = cut(_later(held))
    if dead.count() <= REPLACED:
        gone = dead.toArrow().sort_by("_id")
        known = spark.sparkContext.broadcast((gone["_id"].to_numpy(), gone["_later"].to_numpy()))
        rows = blocks.mapInArrow(_living(known), FRAGMENT)
    else:
        rows = blocks.select("segment", "term", F.explode(F.arrays_zip("ids", "tfs", "dls", "scopes", "positions")).alias("p"))
        rows = _without_replaced(rows.select("segment", F.col("p.ids").alias("id"), "term", "p.tfs", "p.dls", "p.scopes", "p.positions"), held)
        rows = rows.select("term", F.col("scopes").alias("scope"), F.array("id").alias("ids"), F.array("tfs").alias("tfs"), F.array("dls").alias("dls"), F.col("positions").alias("flat"))
    _write(spark, into, 0, rows, cut(_live(held).drop("segment")), None, (0, 0))


def _weight(df: Column, n: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def _share(tf: Column, dl: Column, avg: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avg)))


def search(spark: SparkSession, path: str, query: list[str], k: int | None = None, scope: str | None = None, digits: int | None = None) -> DataFrame:
    """(id, bm25) of live documents that hold any phrase, as a fresh index of them would have it; the best k, if k is given.

    The scope filters results, never the statistics. digits: places after the point that scores are rounded to before they are compared.
    """
    phrases = phrases_of(query)
    none = spark.createDataFrame([], "id long, bm25 double")
    if not phrases or not _exists(spark, path):
        return none
    held = _tables(spark, path)
    segments = held["totals"].collect()  # one row for each segment; merging keeps them few
    n, length = sum(r["n"] for r in segments), sum(r["length"] for r in segments)
    if not n:
        return none
    avg = max(length, 1) / n
    sought = sorted({t for p in phrases for t in p})
    names = spark.createDataFrame([(t,) for t in sought], "t string")
    sizes = sorted({r["buckets"] for r in segments})
    numbers = names.select(*(_bucket(F.col("t"), b).alias(str(b)) for b in sizes)).collect()  # the question's terms
    places = [(F.col("segment") == r["segment"]) & F.col("bucket").isin(sorted({x[str(r["buckets"])] for x in numbers})) for r in segments]
    blocks = held["blocks"].where(reduce(Column.__or__, places) & F.col("term").isin(sought))
    if all(len(p) == 1 for p in phrases):
        return _by_terms(blocks, held, [p[0] for p in phrases], float(n), avg, k, scope, digits)
    return _by_phrases(blocks, held, phrases, float(n), avg, k, scope, digits)


def _best(rows: DataFrame, k: int | None, digits: int | None) -> DataFrame:
    rows = rows if digits is None else rows.withColumn("bm25", F.round("bm25", digits))
    return rows if k is None else rows.orderBy(F.desc("bm25"), "id").limit(k)


def _by_terms(blocks: DataFrame, held: dict[str, DataFrame], words: list[str], n: float, avg: float, k: int | None, scope: str | None, digits: int | None) -> DataFrame:
    spark = blocks.sparkSession
    counted = _without_replaced(blocks.select("segment", "term", F.explode("ids").alias("id")), held).groupBy("term").agg(F.count("*").alias("df"))
    times = spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "term string, times int")
    weights = cut(counted.join(F.broadcast(times), "term").select("term", (_weight(F.col("df"), F.lit(n)) * F.col("times")).alias("weight")))  # the question's terms
    held_blocks = blocks.join(F.broadcast(weights), "term").withColumn("bound", F.col("weight") * _share(F.col("max_tf").cast("double"), F.col("min_dl"), avg))

    def postings(of: DataFrame) -> DataFrame:
        rows = of.select("segment", "term", "weight", F.explode(F.arrays_zip("ids", "tfs", "dls", "scopes")).alias("p"))
        rows = rows.select("segment", "weight", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), F.col("p.scopes").alias("scope"))
        rows = rows.where(F.col("scope") == scope) if scope is not None else rows
        return _without_replaced(rows, held).withColumn("part", F.col("weight") * _share(F.col("tf").cast("double"), F.col("dl"), avg))

    if k is not None:
        most = held_blocks.groupBy("term").agg(F.max("bound").alias("most")).collect()  # the question's terms
        # Of the blocks with the highest bounds, the k-th best document by one term alone: a score that the k-th best has at least
        first = held_blocks.withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy(F.desc("bound"), "segment", "no"))).where(F.col("_r") <= max(2, 4 * k // BLOCK + 1)).drop("_r")
        low = postings(first).groupBy("id").agg(F.max("part").alias("part")).orderBy(F.desc("part")).limit(k).agg(F.count("*"), F.min("part")).first()
        if low[0] == k:
            total = sum(r["most"] for r in most)
            others = F.create_map(*[F.lit(x) for r in most for x in (r["term"], float(total - r["most"]))])
            held_blocks = held_blocks.where(F.col("bound") + F.element_at(others, F.col("term")) >= low[1] * (1 - 1e-9) - (0.0 if digits is None else 10.0**-digits))
    return _best(postings(held_blocks).groupBy("id").agg(F.sum("part").alias("bm25")), k, digits)


def _by_phrases(blocks: DataFrame, held: dict[str, DataFrame], phrases: list[list[str]], n: float, avg: float, k: int | None, scope: str | None, digits: int | None) -> DataFrame:
    rows = blocks.select("segment", "term", F.explode(F.arrays_zip("ids", "dls", "scopes", "positions")).alias("p"))
    rows = rows.select("segment", "term", F.col("p.ids").alias("id"), F.col("p.dls").alias("dl"), F.col("p.scopes").alias("scope"), F.col("p.positions").alias("positions"))
    at = _without_replaced(rows, held).groupBy("id", "dl", "scope").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # the question's terms

    def starting(term: str, back: int) -> Column:
        return F.transform(F.coalesce(F.try_element_at("at", F.lit(term)), F.array().cast("array<int>")), lambda x: x - back)

    counts = [F.size(reduce(F.array_intersect, [starting(t, i) for i, t in enumerate(p)])) for p in phrases]
    found = cut(at.select("id", "dl", "scope", F.array(*counts).alias("tf")).where(F.exists("tf", lambda t: t > 0)))
    dfs = found.agg(F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(len(phrases)))).alias("_df"))
    found = found.where(F.col("scope") == scope) if scope is not None else found
    parts = [_weight(F.col("_df")[i], F.lit(n)) * _share(F.col("tf")[i].cast("double"), F.col("dl"), avg) for i in range(len(phrases))]
    return _best(found.crossJoin(F.broadcast(dfs)).select("id", reduce(Column.__add__, parts).alias("bm25")), k, digits)  # dfs: one row
