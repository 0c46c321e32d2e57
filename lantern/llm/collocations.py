"""Phrase collocations by position bitmaps, mined depth-first in shards.

1. Texts become shards of one language each: the distinct words, and the sequence of their numbers
   with a gap after each piece. Shards are written once; later rounds read no text.
2. A shard's sequence is cut into containers of 512 positions at most. In a container each word
   has a bitmap of its positions (words that don't stand there have none): a phrase's bitmap,
   shifted by one, AND a word's bitmap is the bitmap of the longer phrase; its popcount is the
   phrase's count. Gaps have no bit, so no phrase crosses one. A piece that is longer than a
   container goes on in the next, and a phrase counts where it starts. Some containers at a time are
   worked on side by side and down to the longest phrases, before the next are read.
3. Popcounts are summed over shards: first of words, then of pairs of frequent words, then, depth
   first, of longer phrases all of whose pairs are frequent. After the first two rounds each
   shard is told which of its own words and pairs are frequent, by joins: nothing is broadcast.
4. Frequent phrases, a row each, meet the counts of their parts by joins. The best of a language
   are taken by rank, ties included, before their words are looked up.

A null text is empty, a null language is `und`. Empty texts and tables give no rows. Repeated rows
count each. Texts are read whole, of any length. Other columns of the input are not read.
Arithmetic that may pass 64 bits is done in decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Positions of a container, a multiple of 64; containers that are worked on together; words of a shard. All bound a task's memory.
BITS, SLAB, SHARD = 512, 256, 1 << 23
#: Phrases that a task holds before it sums their counts and hands them on.
HELD = 2_000_000
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
SHARDS = "shard long, lang string, total long, words array<string>, counts array<int>, sequence binary"


class _Shard:
    def __init__(self):
        self.ids: defaultdict[bytes | None, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[None]  # 0 is the gap
        self.sequence: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        out: list[int] = []
        number = self.ids.__getitem__
        for piece in text.translate(_CLEAN).split(b"\n"):
            if words := piece.split():  # no other white space of ASCII is left than blanks and tabs
                out += map(number, words)
                out.append(0)
        self.sequence.append(np.array(out, dtype=np.int32))
        return len(out)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        seq = np.concatenate(self.sequence)
        counts = np.bincount(seq, minlength=len(self.ids))[1:].astype(np.int32)
        words = pa.array([w for w in self.ids if w is not None], pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(counts))]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([int(counts.sum())]), *lists, pa.array([zlib.compress(seq.tobytes(), 1)])], names=["shard", "lang", "total", "words", "counts", "sequence"])


def _sharder(most: int):
    def run(batches):
        held: defaultdict[str, _Shard] = defaultdict(_Shard)
        first, n, size = TaskContext.get().partitionId() << 12, 0, 0  # a shard has two million words at least, but for the last
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if text := text.as_py():
                    size += held[lang].add(text)
                if size >= most:
                    for name, s in held.items():
                        yield s.row(first + n, name)
                        n += 1
                    held.clear()
                    size = 0
        for name, s in held.items():
            yield s.row(first + n, name)
            n += 1

    return run


def containers(seq: np.ndarray, most: int, bits: int):
    """(first, end, starts) of each container. Pieces are whole, or go on in the next container and end with a look ahead."""
    at, gaps = 0, np.flatnonzero(seq == 0)
    while at < seq.size:
        end = min(at + bits, seq.size)
        gap = np.searchsorted(gaps, end) - 1
        if end == seq.size or gap >= 0 and gaps[gap] >= at:
            upto = end if end == seq.size else int(gaps[gap]) + 1
            if upto - at > 1:
                yield at, upto, upto - at
            at = upto
        else:
            yield at, end, end - at - (most - 1)
            at = end - (most - 1)


def slabs(seq: np.ndarray, most: int, bits: int):
    """Containers side by side, SLAB at a time: (numbers, one row for each container; starts of each)."""
    held = []
    for found in containers(seq, most, bits):
        held.append(found)
        if len(held) == SLAB:
            yield _side_by_side(seq, held, bits)
            held = []
    if held:
        yield _side_by_side(seq, held, bits)


def _side_by_side(seq: np.ndarray, held: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(held), bits), dtype=np.int32)
    for k, (first, end, _) in enumerate(held):
        out[k, : end - first] = seq[first:end]
    return out, np.array([starts for _, _, starts in held])


def _bit(n: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (n & 63).astype(np.uint64)


def shifted(bitmaps: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) moved on by one position; the last one leaves its container."""
    out = bitmaps << np.uint64(1)
    out[:, 1:] |= bitmaps[:, :-1] >> np.uint64(63)
    return out


def mine(numbers: np.ndarray, starts: np.ndarray, most: int, frequent: np.ndarray | None = None):
    """(words of each phrase as columns, counts) of the phrases of 2 to most words, a size at a time.

    frequent: sorted codes first * 2^32 + second of pairs; phrases with another pair are not extended.
    """
    bits = numbers.shape[1]
    flat = numbers.ravel()
    place = np.arange(flat.size)
    held = np.flatnonzero(flat)
    # A bitmap for each word of each container where it stands
    key, at = np.unique((held // bits) << 32 | flat[held], return_inverse=True)
    word_row = np.full(flat.size, -1, dtype=np.int64)
    word_row[held] = at
    words = np.zeros((key.size, bits // 64), dtype=np.uint64)
    np.add.at(words.reshape(-1), at * (bits // 64) + (held % bits) // 64, _bit(held))  # each bit once
    limit = np.where(np.arange(bits // 64)[None, :] * 64 + 64 <= starts[:, None], ~np.uint64(0), np.uint64(0))
    edge = np.flatnonzero(starts < bits)
    limit[edge, starts[edge] // 64] = _bit(starts[edge]) - np.uint64(1)
    word_of = (key & 0xFFFFFFFF).astype(np.int32)
    ends, end_row, columns = words & limit[key >> 32], word_row, [word_of]
    for _ in range(2, most + 1):
        next_ = place[1:][(end_row[:-1] >= 0) & (word_row[1:] >= 0) & (place[1:] % bits != 0)]
        if frequent is not None:
            code = flat[next_ - 1].astype(np.int64) << 32 | flat[next_]
            near = np.searchsorted(frequent, code)
            next_ = next_[frequent[np.minimum(near, frequent.size - 1)] == code] if frequent.size else next_[:0]
        if not next_.size:
            return
        # The phrases that may stand here, and the bitmap of each: shift, AND, popcount
        pair, at = np.unique(end_row[next_ - 1] * key.size + word_row[next_], return_inverse=True)
        phrase, word = pair // key.size, pair % key.size
        ends = shifted(ends[phrase]) & words[word]
        n = np.bitwise_count(ends).sum(1, dtype=np.int64)
        columns = [*(c[phrase] for c in columns), word_of[word]]
        there = n > 0
        yield [c[there] for c in columns], n[there]
        end_row = np.full(flat.size, -1, dtype=np.int64)
        end_row[next_] = np.where(there[at], at, -1)


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each phrase once, its counts summed."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    fresh = np.ones(n.size, dtype=bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(fresh)
    return [c[at] for c in columns], np.add.reduceat(n[order], at)


def _all_of(seq: np.ndarray, most: int, bits: int, frequent: np.ndarray | None = None, least: int = 2):
    """(words as columns, counts) of a shard's phrases of least to most words, summed over up to HELD rows."""
    held: dict[int, list] = defaultdict(list)
    rows: Counter = Counter()
    for numbers, starts in slabs(seq, most, bits):
        for columns, n in mine(numbers, starts, most, frequent):
            size = len(columns)
            if size < least:
                continue
            held[size].append((columns, n))
            rows[size] += n.size
            if rows[size] >= HELD:
                yield summed([np.concatenate(c) for c in zip(*(c for c, _ in held[size]), strict=True)], np.concatenate([n for _, n in held.pop(size)]))
                rows[size] = 0
    for found in held.values():
        yield summed([np.concatenate(c) for c in zip(*(c for c, _ in found), strict=True)], np.concatenate([n for _, n in found]))


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


def _coded(batches):
    """A shard's sequence over its frequent words only, the rest as gaps, of which one is kept; the words' numbers, sorted; and the words that are first met here."""
    for row in _rows(batches):
        seq = np.frombuffer(zlib.decompress(row["sequence"].as_py()), dtype=np.int32)
        known = row["known"].values
        local, ids = (known.field(k).to_numpy() for k in ("i", "id"))
        order = np.argsort(ids)
        table = np.zeros(int(max(seq.max(initial=0), local.max(initial=0))) + 1, dtype=np.int32)
        table[local[order]] = np.arange(1, local.size + 1, dtype=np.int32)
        seq = table[seq]
        keep = np.ones(seq.size, dtype=bool)
        keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
        head = known.filter(known.field("f").is_valid())
        words = row["words"].values.take(pa.array(head.field("i").to_numpy() - 1))
        heads = pa.StructArray.from_arrays([head.field("id"), words, head.field("f")], names=["id", "word", "f"])
        packed = [pa.array([zlib.compress(x.tobytes(), 1)]) for x in (seq[keep], ids[order].astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([row["shard"].as_py()]), pa.array([row["lang"].as_py()]), *packed, pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), heads)], names=["shard", "lang", "sequence", "ids", "heads"])


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    seq, ids = (np.frombuffer(zlib.decompress(row[c].as_py()), dtype=t) for c, t in (("sequence", np.int32), ("ids", np.int64)))
    return seq, np.concatenate([[-1], ids])


def _count_pairs(most: int, bits: int):
    def run(batches):
        for row in _rows(batches):
            seq, ids = _read(row)
            for (a, b), n in _all_of(seq, most, bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n.size, row["shard"].as_py())), pa.array(ids[a]), pa.array(ids[b]), pa.array(n.astype(np.int32))], names=["shard", "a", "b", "n"])

    return run


def _packed(batches):
    """A shard's pairs, sorted and compressed."""
    for row in _rows(batches):
        a, b = (row[c].values.to_numpy() for c in ("a", "b"))
        order = np.lexsort((b, a))
        packed = zlib.compress(np.stack([np.diff(a[order], prepend=0), b[order]]).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([row["shard"].as_py()]), pa.array([packed]), pa.ListArray.from_arrays(pa.array([0, len(row["told"].values)], pa.int32()), row["told"].values)], names=["shard", "pairs", "told"])


def _count_longer(most: int, bits: int):
    """Phrases by their words' global numbers, summed over a task's shards as long as they are HELD at most."""

    def out(held: list) -> pa.RecordBatch:
        columns, n = summed([np.concatenate(c) for c in zip(*(c for c, _ in held), strict=True)], np.concatenate([n for _, n in held]))
        words = np.stack(columns, 1)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)), pa.array(words.ravel())), pa.array(n)], names=["p", "n"])

    def run(batches):
        held, rows = defaultdict(list), Counter()
        for row in _rows(batches):
            seq, ids = _read(row)
            gaps, second = np.frombuffer(zlib.decompress(row["pairs"].as_py()), dtype=np.int64).reshape(2, -1)
            a, b = np.searchsorted(ids, np.cumsum(gaps)), np.searchsorted(ids, second)
            for columns, n in _all_of(seq, most, bits, np.sort(a << 32 | b), 3):
                size = len(columns)
                held[size].append(([ids[c] for c in columns], n))
                rows[size] += n.size
                if rows[size] >= HELD:
                    yield out(held.pop(size))
                    rows[size] = 0
        for found in held.values():
            yield out(found)

    return run


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return C.cut(C.small_batches(rows).mapInArrow(_sharder(SHARD), SHARDS))


def frequent_phrases(held: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word) of frequent words, and (p: ids of a phrase's words, f: its count) of all frequent phrases of 1 to most words."""
    # explode() of two arrays zipped, so that a shard's words come out of a generator
    # A word's number is that of its first shard and its place there
    words = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("shard", "lang", (F.col("at") + 1).alias("i"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = words.withColumn("own", F.shiftleft("shard", 27) + F.col("i"))
    same = Window.partitionBy("lang", "word")  # a row for each shard
    often = words.withColumn("f", F.sum("n").over(same)).withColumn("id", F.min("own").over(same)).where(F.col("f") >= least)
    told = often.groupBy("shard").agg(F.collect_list(F.struct("i", "id", F.when(F.col("own") == F.col("id"), F.col("f")).alias("f"))).alias("known"))  # a shard's own words
    coded = C.small_batches(held.select("shard", "lang", "sequence", "words").join(told, "shard"))
    coded = C.cut(coded.mapInArrow(_coded, "shard long, lang string, sequence binary, ids binary, heads array<struct<id:long,word:string,f:long>>"))
    known = coded.select("lang", F.explode("heads").alias("h")).select("h.id", "lang", "h.word", "h.f")
    counted = coded.select("shard", "sequence", "ids").mapInArrow(_count_pairs(2, BITS), "shard long, a long, b long, n int")
    alike = Window.partitionBy("a", "b")  # a row for each shard
    often = counted.withColumn("f", F.sum("n").over(alike)).withColumn("_first", F.min("shard").over(alike)).where(F.col("f") >= least)
    # A shard's own pairs, and each pair's count once. Both lists are gathered from the same rows in the same order.
    own = often.groupBy("shard").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list(F.when(F.col("shard") == F.col("_first"), F.struct("a", "b", "f"))).alias("told"))
    pairs = C.cut(own.mapInArrow(_packed, "shard long, pairs binary, told array<struct<a:long,b:long,f:long>>"))
    longer = coded.select("shard", "sequence", "ids").join(pairs.select("shard", "pairs"), "shard").mapInArrow(_count_longer(most, BITS), "p array<long>, n long")
    longer = longer.groupBy("p").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    two = pairs.select(F.explode("told").alias("x")).select(F.array("x.a", "x.b").alias("p"), "x.f")
    return known.select("id", "lang", "word"), C.cut(known.select(F.array("id").alias("p"), "f").union(two).union(longer))


def _exact(name: str):
    return F.col(name).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, most: int = 4, top: int = 2000, cover: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to most words that stand least times."""
    held = shards(docs, text_col, lang_col)
    words, phrases = frequent_phrases(held, least, most)
    size = F.size("p")
    candidates = phrases.where(size >= 2).withColumnRenamed("f", "a")
    cuts = candidates.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("p", F.lit(1), F.col("k"))).withColumn("right", F.slice("p", F.col("k") + 1, size - F.col("k")))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select(F.col("p").alias(side), F.col("f").alias(count)), side)  # parts of frequent phrases are frequent
    cuts = cuts.withColumn("x", F.lit(2_000_000).cast("decimal(7,0)") * _exact("a")).withColumn("y", _exact("l") + _exact("r"))
    scored = cuts.groupBy("p", "a").agg(F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("cut"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("p", s, m))))
    within = candidates.where(size >= 3).select(F.explode(inside).alias("p"), "a").groupBy("p").agg(F.max("a").alias("longer"))
    alone = scored.join(within, "p", "left").where("longer is null or 100 * cast(longer as decimal(19,0)) < %d * cast(a as decimal(19,0))" % cover)
    alone = alone.join(words.select(F.col("id").alias("first"), "lang"), F.col("p")[0] == F.col("first")).select("lang", "p", "a", "cut.*")
    order = [F.desc("score"), F.desc("a")]
    best = C.cut(alone.withColumn("tied", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("tied") <= top))
    spelled = best.select("lang", "p", F.posexplode("p").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("lang", "p")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(spelled, ["lang", "p"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    totals = held.groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for collocations() of documents.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM worded
), spoken AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM sized WHERE len(w) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM spoken GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30
), cut_at AS (
  SELECT *, unnest(range(1, size)) AS k FROM candidates
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cut_at AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_sizes AS (
  SELECT *, unnest(range(2, size)) AS m FROM candidates
), inner_phrases AS (
  SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM inner_sizes
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, phrase
), kept AS (
  SELECT o.* FROM lowest AS o LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
