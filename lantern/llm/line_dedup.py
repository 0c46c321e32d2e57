"""Line dedup by a log-template tree.

Every line is parsed down a tree of fixed depth: its number of words, then its `depth` first
words, where variable fields (words with a digit or an @, quoted strings) count as
`<*>`. Leaves that hold lines of `min_docs` documents at least are generalised: lines of a leaf that
agree in `similarity` of their words, directly or over others, are one template, whose other words
are variable too. Lines that agree so far share a run of words whole (the words beyond the tree
are cut into one run more than may differ), so only lines of equal runs are compared; the many
lines of a common run are compared by blocks. The outcome depends on the set of lines alone, not
on their order or number.

A template recurs, and all its lines are dropped, if it stands in `min_docs` documents at
least, wherever it stands in them and whatever surrounds it. A group of near copies counts as
one document, so a template doesn't recur by being copied along with all of its document; equal
texts count as one from the start. Near copies are documents whose templates, weighted by their
words, agree to `alike` (Jaccard), directly or over others; candidates come from weighted
MinHash and are verified. Near copies themselves are left to near-duplicate operators.

The keys of the lines to drop go to the tasks that hold the texts; where there are more than
`most_keys` of them, their numbers are joined to the texts instead.

Lines are separated by \\n. Blank lines are kept. A null or empty text comes back as it is,
with 0 lines dropped; a text of which all lines recur comes back empty. Rows with null or
repeated ids are treated by their texts alone, one result row for each. Columns of the input
named like the result's are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

QUOTED, VARIABLE = re.compile(r'"[^"]*"'), re.compile("[0-9@]")
MAY_VARY = re.compile('[0-9@"]')
#: Lines of a block; two blocks are compared at once. Rows that go to a task in one call.
BLOCK, BATCH = 2048, 20_000
#: MinHash values of a document, and values in a band: a pair that agrees to 0.8 is missed with probability 2e-4.
HASHES, BAND = 64, 4
#: Keys that are broadcast at most, 8 bytes each.
SMALL = 1_000_000


def masked(line: str) -> list[str]:
    if not MAY_VARY.search(line):
        return line.split()
    return ["<*>" if VARIABLE.search(w) else w for w in QUOTED.sub("<*>", line).split()]


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def leaf_of(words: list[str], depth: int) -> int:
    return key(f"{len(words)} " + " ".join(words[:depth]))


def may_differ(size: int, similarity: float) -> int:
    """Words of `size` in which two lines of a template may differ."""
    return size - math.ceil(similarity * size - 1e-9)


def _parser(depth: int):
    """(doc, line key, leaf key, words) of the lines that aren't blank."""

    def run(batches):
        for batch in batches:
            docs, lines, leaves, sizes = [], [], [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in map(masked, text.split("\n")):
                    if w:
                        docs.append(doc)
                        lines.append(key(" ".join(w)))
                        leaves.append(leaf_of(w, depth))
                        sizes.append(len(w))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lines, pa.int64()), pa.array(leaves, pa.int64()), pa.array(sizes, pa.int32())], names=["doc", "line", "leaf", "size"])

    return run


def _wording(depth: int, wanted):
    """(leaf, line, keys of the words) of all lines, or of those of the wanted leaves."""

    def run(batches):
        leaves_wanted = None if wanted is None else set(wanted.value.tolist())
        for batch in batches:
            leaves, lines, words = [], [], []
            for text in batch.column("text").to_pylist():
                for w in map(masked, text.split("\n")):
                    if w and (leaves_wanted is None or leaf_of(w, depth) in leaves_wanted):
                        leaves.append(leaf_of(w, depth))
                        lines.append(key(" ".join(w)))
                        words.append(list(map(key, w)))
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(lines, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["leaf", "line", "words"])

    return run


def runs(words: list[int], depth: int, similarity: float) -> list[int]:
    """A key for each run of the words beyond the tree."""
    n = may_differ(len(words), similarity) + 1
    rest = words[depth:]
    cuts = [len(rest) * i // n for i in range(n + 1)]
    return [xxhash.xxh3_64_intdigest(np.array(rest[a:b], np.int64).tobytes(), seed=i) - (1 << 63) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def _runs(depth: int, similarity: float):
    def run(batches):
        for batch in batches:
            found = [runs(w, depth, similarity) for w in batch.column("words").to_pylist()]
            n = [len(x) for x in found]
            at = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([batch.column("leaf").take(pa.array(at)), batch.column("line").take(pa.array(at)), pa.array([x for f in found for x in f], pa.int64())], names=["leaf", "line", "run"])

    return run


def agreeing(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of left agree with which of right in enough of their words."""
    same = np.zeros((len(left), len(right)), dtype=np.int32)
    for a in range(0, left.shape[1], 8):
        same += (left[:, None, a : a + 8] == right[None, :, a : a + 8]).sum(2, dtype=np.int32)
    return same >= left.shape[1] - may_differ(left.shape[1], similarity)


def _linker(similarity: float):
    """A spanning forest of the links of each pair of blocks."""

    def run(tbl):
        tbl = tbl.sort_by([("place", "ascending"), ("line", "ascending")])
        place, line, block, first, second = (tbl.column(c).to_numpy() for c in ("place", "line", "block", "first", "second"))
        words = tbl.column("words").combine_chunks()
        flat, offset = words.values.to_numpy(), words.offsets.to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        out_a, out_b = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            x = flat[offset[a] : offset[b]].reshape(b - a, -1)
            l, r = np.flatnonzero(block[a:b] == first[a]), np.flatnonzero(block[a:b] == second[a])
            i, j = np.nonzero(agreeing(x[l], x[r], similarity))
            i, j = l[i], r[j]
            root = C.star_edges(b - a, i[i != j], j[i != j])
            moved = np.flatnonzero(root != np.arange(b - a))
            out_a.append(line[a:b][moved])
            out_b.append(line[a:b][root[moved]])
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})

    return run


def _few(keys: DataFrame, most: int = SMALL):
    """keys, written; and as a broadcast array if there are few enough, else None."""
    keys = C.cut(keys)
    if keys.count() > most:
        return keys, None
    held = np.sort(np.array([r[0] for r in keys.toLocalIterator()], dtype=np.int64))
    return keys, keys.sparkSession.sparkContext.broadcast(held)


def templates_of(texts: DataFrame, lines: DataFrame, min_docs: int, depth: int, similarity: float) -> DataFrame:
    """(line, template) for the distinct lines of leaves that min_docs documents share. lines: distinct (doc, line, leaf, size)."""
    distinct = lines.groupBy("leaf", "line", "size").agg(F.count("*").alias("n"))
    leaves = distinct.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("lines")).where(F.col("docs") >= min_docs).select("leaf", "lines")
    inside = C.cut(distinct.join(leaves, "leaf").select("leaf", "line", "size", "lines"))
    # Lines too short to differ in more than they may are one template; so is a leaf's only line.
    free = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - F.lit(1e-9)) >= F.col("size") - depth
    whole = inside.where(free | (F.col("lines") == 1)).select("line", F.col("leaf").alias("template"))
    several = inside.where(~free & (F.col("lines") > 1))
    wanted, few = _few(several.select("leaf").distinct())
    worded = texts.mapInArrow(_wording(depth, few), "leaf long, line long, words array<long>")
    worded = C.cut((worded if few else worded.join(wanted, "leaf", "left_semi")).dropDuplicates(["leaf", "line"]))
    keys = worded.mapInArrow(_runs(depth, similarity), "leaf long, line long, run long")
    # Runs that hold the same lines need one comparison.
    common = (
        keys.groupBy("leaf", "run").agg(F.count("*").alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("members")).where("n > 1")
        .groupBy("leaf", "n", "members").agg(F.min("run").alias("run")).select("leaf", "run", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    met = keys.join(common, ["leaf", "run"]).withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    met = C.cut(met.select("leaf", "line", "block", "first", "second", F.xxhash64("leaf", "run", "first", "second").alias("place")))
    tasks = max(1, -(-met.count() // BATCH))
    links = met.join(worded, ["leaf", "line"]).groupBy(F.pmod("place", F.lit(tasks))).applyInArrow(_linker(similarity), "a long, b long")
    groups = C.components(links.distinct(), "a", "b").select(F.col("node").alias("line"), F.col("component").alias("template"))
    rest = several.select("line").join(groups, "line", "left").select("line", F.coalesce("template", "line").alias("template"))
    return whole.union(rest)


def _bands(batches):
    """(doc, key) for the bands of the weighted MinHash values of each document's templates."""
    rng = np.random.default_rng(13)
    m = rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        held = batch.column("held")
        flat = held.flatten()
        t, size = flat.field("template").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("size").to_numpy(zero_copy_only=False)
        at = (held.offsets.to_numpy() - held.offsets[0].as_py())[:-1]
        signature = np.zeros((len(at), HASHES), dtype=np.uint64)
        for i in range(HASHES if len(at) else 0):
            u = (C.mix(t * m[i] + np.uint64(i)) >> np.uint64(11)).astype(np.float64) + 0.5
            signature[:, i] = np.minimum.reduceat(-np.log(u / 2**53) / size, at).view(np.uint64)
        keys = C.band_keys(signature, BAND)
        docs = np.repeat(batch.column("doc").to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys.ravel(), pa.int64())], names=["doc", "key"])


def near_copies(named: DataFrame, alike: float) -> DataFrame:
    """(doc, copied): one document of its group for each document that has near copies. named: (doc, template, size)."""
    held = named.groupBy("doc", "template").agg(F.max("size").alias("size"))
    shared = held.groupBy("template").agg(F.count("*").alias("n")).where("n > 1").select("template", F.lit(1).alias("shared"))
    held = held.join(_small(shared), "template", "left").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("template", "size"))).alias("held"), F.sum("size").alias("total"), F.sum(F.col("size") * F.col("shared")).alias("common"))
    held = C.cut(held.where(F.col("common") >= alike * F.col("total")).select("doc", "held", "total"))  # others agree with none
    keys = C.cut(held.mapInArrow(_bands, "doc long, key long"))
    # Broadcast, so that the many documents of one key stay where they are; beyond that AQE may split them.
    first = keys.groupBy("key").agg(F.min("doc").alias("copied"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keys.join(_small(first), "key").where("doc <> copied").select("doc", "copied").distinct()
    pairs = pairs.join(held, "doc").join(held.select(F.col("doc").alias("copied"), F.col("held").alias("other"), F.col("total").alias("others")), "copied")
    both = F.aggregate(F.array_intersect("held", "other"), F.lit(0).cast("long"), lambda a, x: a + x["size"])
    near = pairs.withColumn("both", both).where(F.col("both") >= alike * (F.col("total") + F.col("others") - F.col("both")))
    return C.components(near, "doc", "copied").select(F.col("node").alias("doc"), F.col("component").alias("copied"))


def _small(keys: DataFrame) -> DataFrame:
    """keys, broadcast if there are few enough."""
    keys = C.cut(keys)
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def recurring(texts: DataFrame, min_docs: int, depth: int, similarity: float, alike: float) -> DataFrame:
    """(line): keys of the lines whose template recurs. texts: (doc, text), no text null or empty."""
    lines = C.cut(texts.mapInArrow(_parser(depth), "doc long, line long, leaf long, size int").distinct())
    templates = C.cut(templates_of(texts, lines, min_docs, depth, similarity))
    named = C.cut(lines.drop("leaf").join(templates, "line", "left").select("doc", F.coalesce("template", "line").alias("template"), "size").distinct())
    often = named.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    found = named.join(_small(often), "template", "left_semi").select("doc", "template")
    # One row of each group for a template; neither step gathers a template in one task.
    once = found.join(near_copies(named, alike), "doc", "left").select("template", F.coalesce("copied", "doc").alias("group")).distinct()
    recurs = once.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    return templates.join(_small(recurs), "template", "left_semi").select("line").distinct()


def _dropper(text_col: str, held):
    """Batches without the lines of held keys."""

    def run(batches):
        bad = np.append(held.value, np.iinfo(np.int64).max)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            dropped = np.zeros(len(texts), dtype=np.int32)
            for a, b in C.chunks(texts):
                lines = [t.split("\n") if t else [] for t in texts[a:b]]
                keys = [key(" ".join(w)) if (w := masked(x)) else None for own in lines for x in own]
                blank = np.array([k is None for k in keys], dtype=bool)
                keys = np.array([k or 0 for k in keys], dtype=np.int64)
                place = np.searchsorted(bad, keys)
                gone = (bad[place] == keys) & (place < held.value.size) & ~blank
                first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(int)
                dropped[a:b] = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                for i in np.flatnonzero(dropped[a:b]):
                    texts[a + i] = "\n".join([x for x, g in zip(lines[i], gone[first[i] : first[i + 1]], strict=True) if not g])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped)], names=[*batch.schema.names, "lines_dropped"])
        C.trim()

    return run


def _numbers(batches):
    """(doc, no, line) of the lines that aren't blank."""
    for batch in batches:
        docs, nos, lines = [], [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for no, w in enumerate(map(masked, text.split("\n"))):
                if w:
                    docs.append(doc)
                    nos.append(no)
                    lines.append(key(" ".join(w)))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(nos, pa.int32()), pa.array(lines, pa.int64())], names=["doc", "no", "line"])


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 5, depth: int = 3, similarity: float = 0.7, alike: float = 0.8, most_keys: int = 2_000_000) -> DataFrame:
    """The rows of docs with the kept lines in text_col, and `lines_dropped`."""
    rows = C.small_batches(docs).drop("lines_dropped")
    texts = rows.where(F.length(text_col) > 0).select(F.xxhash64(text_col).alias("doc"), F.col(text_col).alias("text"))
    bad, held = _few(recurring(texts, min_docs, depth, similarity, alike), most_keys)
    if held:
        schema = T.StructType([*rows.schema.fields, T.StructField("lines_dropped", T.IntegerType())])
        return rows.mapInArrow(_dropper(text_col, held), schema)
    numbers = texts.mapInArrow(_numbers, "doc long, no int, line long").join(bad, "line").groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("no").alias("_nos"))
    joined = rows.select(F.struct(*rows.columns).alias("_row"), F.xxhash64(text_col).alias("_doc")).join(numbers, "_doc", "left")
    text = F.col(f"_row.{text_col}")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_nos", i)), "\n")
    out = [F.when(F.col("_nos").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in rows.columns]
    return joined.select(*out, F.when(F.col("_nos").isNull(), 0).otherwise(F.size("_nos")).alias("lines_dropped"))
