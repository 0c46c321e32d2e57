"""Resampling of documents towards a target's n-gram distribution, by a dictionary of distinct features.

1. Features (runs of `low` to `high` words) are counted inside the tasks and then globally: the
   dictionary holds each distinct string once, and each string is hashed to its bucket once.
2. Buckets sum the dictionary's counts; the corpus's and the target's bucket sums give a gain for
   each bucket. There are `buckets` rows of them, whatever the corpus.
3. Gains go back to the dictionary's strings, and these to the feature counts of each document.
   Strings with a 20,000th of all occurrences or more are 20,000 at most; with up to 64 bytes
   each they are known to every task. All others are joined by shuffle, and none of them is
   hot: a longer string of such a share is left to Spark's splitting of skewed joins.
4. The score is a document's weight plus Gumbel noise from its id, so that the highest scores are
   a draw without replacement. Ranks come from a range-partitioned sort and the partitions' sizes.

Null and empty texts have no features: weight 0. A row without an id has no noise: its score is
null, it can't be drawn and doesn't count among those that can. Ids may repeat: each row has its own
result. Texts of any length are read whole, one at a time. Other columns of the input are not
read. Empty tables give an empty result; an empty target leaves the corpus's own distribution.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Distinct features that a task holds before it hands its counts on; bounds its memory.
HELD = 400_000
#: Features with this share of all occurrences are few: 1 / HOT at most.
HOT, HOT_BYTES = 1 / 20_000, 64
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def features(text: bytes | None, low: int, high: int) -> Counter:
    """Runs of low to high words of a UTF-8 text and their counts. Only A-Z are lower-cased."""
    words = (text or b"").translate(_WORDS).split()
    out = Counter(words) if low <= 1 <= high else Counter()
    for n in range(max(low, 2), high + 1):
        out.update(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return out


def dictionary(rows: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """(feature, n, bucket): each distinct feature of rows.text (bytes), counted and hashed once."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(features(text.as_py(), low, high))
                if len(held) >= HELD:
                    yield _pairs(held)
                    held = Counter()
        yield _pairs(held)

    counted = C.small_batches(rows).mapInArrow(count, "feature string, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)))


def _pairs(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["feature", "n"])


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, from the dictionaries of corpus and target."""
    sums = [d.groupBy("bucket").agg(F.sum("n").alias(n)) for d, n in ((corpus, "s"), (target, "t"))]
    all_of = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(sums[0], "bucket", "left").join(sums[1], "bucket", "left").na.fill(0)
    totals = all_of.agg(F.sum("s").cast("double").alias("_s"), F.sum("t").cast("double").alias("_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("_t") + float(buckets)))
    return all_of.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))  # totals: one row


#: Features in an output batch of a task, about.
OUT = 50_000


def _scorer(low: int, high: int, known):
    """Rows to (k1, k2, n_words, n_features, weight of hot features, copies, the other features and their counts)."""

    def run(batches):
        hot = known.value
        for batch in batches:
            out, size = [], 0
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                found = features(text, low, high)
                n_words = found.total() if low == high == 1 else len((text or b"").translate(_WORDS).split())
                weight = sum(hot[f] * n for f, n in found.items() if f in hot)
                rest = [(f, n) for f, n in found.items() if f not in hot]
                out.append((k1, k2, n_words, found.total(), weight, 1, rest[:OUT]))
                out += [(k1, k2, 0, 0, 0, 0, rest[at : at + OUT]) for at in range(OUT, len(rest), OUT)]  # of a very long text
                size += len(rest)
                if size >= OUT or len(out) >= OUT // 10:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(6)]
    pairs = [x for r in out for x in r[6]]
    ends = np.cumsum([0, *(len(r[6]) for r in out)])
    held = pa.StructArray.from_arrays([pa.array([f for f, _ in pairs], pa.binary()).cast(pa.string()), pa.array([n for _, n in pairs], pa.int32())], names=["feature", "m"])
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], names=[*HEAD, "rest"])


HEAD = ["k1", "k2", "n_words", "n_features", "hot", "copies"]


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """(id, n_words, n_features, weight), a row for each of docs."""
    keys = C.row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), *keys)
    own = C.cut(dictionary(rows.select("text"), low, high, buckets))
    sought = dictionary(target.select(F.col(text_col).cast("binary").alias("text")), low, high, buckets)
    gained = own.join(F.broadcast(gains(own, sought, buckets)), "bucket")  # one row for each bucket
    least = (own.agg(F.sum("n")).first()[0] or 0) * HOT
    is_hot = (F.col("n") >= least) & (F.octet_length("feature") <= HOT_BYTES)
    hot = {r["feature"].encode(): r["gain"] for r in gained.where(is_hot).select("feature", "gain").collect()}  # 1 / HOT at most
    run = _scorer(low, high, rows.sparkSession.sparkContext.broadcast(hot))
    counted = C.small_batches(rows).mapInArrow(run, ", ".join(f"{c} long" for c in HEAD) + ", rest array<struct<feature string, m int>>")
    each = counted.select(*HEAD, F.posexplode_outer("rest").alias("at", "one"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    # A row without other features gets a name of its own that no feature has, so that such rows don't meet in one task
    feature = F.coalesce(F.col("one.feature"), F.concat(F.lit("\x00"), F.hex("k1")))
    each = each.select("k1", "k2", *(F.when(first, F.col(c)).otherwise(0).alias(c) for c in HEAD[2:]), feature.alias("feature"), "one.m")
    each = each.join(gained.where(~is_hot).select("feature", "gain"), "feature", "left")
    summed = each.groupBy("k1", "k2").agg(*(F.sum(c).alias(c) for c in HEAD[2:]), F.sum(F.col("gain") * F.col("m")).alias("cold"))
    each_row = summed.select("k1", "k2", F.expr("n_words div copies").alias("n_words"), F.expr("n_features div copies").alias("n_features"), F.expr("(hot + coalesce(cold, 0)) div copies").alias("weight"))
    return docs.select(F.col(id_col), *keys).join(each_row, ["k1", "k2"]).drop("k1", "k2")


def resample(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null for rows that aren't drawn."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000.0 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = C.cut(weights(docs, target, id_col, text_col, low, high, buckets).withColumn("score", F.col("weight") + gumbel))
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    ranked = ranks(scored.where(may), [F.desc("score"), F.col(id_col)])
    drawn = scored.where(may).count() * share // 100
    rest = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)
    return out.select(id_col, "n_features", "weight", "score", "rank")


def ranks(rows: DataFrame, order: list) -> DataFrame:
    """rows with `rank` from 1: partitions sorted by range, each told how many rows stand before it."""
    placed = C.cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_at", "_part", "_before")


#: DuckDB SQL for resample() of documents towards benchmark. The CRC comes from its table of 256 remainders.
ORACLE = r"""
WITH RECURSIVE remainder(i, c, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) AS t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM remainder WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM remainder WHERE k = 8
), words AS (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), counts AS (
  SELECT side, f, count(*) AS n FROM (SELECT side, unnest(w) AS f FROM words) GROUP BY side, f
), strings AS (
  SELECT DISTINCT f FROM counts
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::INT, 2))::UBIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM strings, tab
), sums AS (
  SELECT b.i AS bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM range(10000) AS b(i) LEFT JOIN (SELECT side, n, bucket FROM counts JOIN hashed USING (f)) AS c ON c.bucket = b.i GROUP BY b.i
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums
), own AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM (SELECT r, unnest(w) AS f FROM words WHERE side = 's') JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT id AS doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN own USING (r) WHERE side = 's'
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 AND score IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) END AS place,
         count(*) FILTER (n_features >= 20 AND score IS NOT NULL) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN place END AS rank FROM placed"""
