"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as their lower-cased letters and digits with single
spaces between words. An occurrence of an item of m characters with at most k edits shares
m + 1 - q(k + 1) of the item's q-grams at least, all of them on k + 1 neighbouring diagonals
(place in the text less place in the item). Diagonals are counted in bands of 2(k + 1) that
overlap by half, so one band holds the whole occurrence. Bands that reach the bound are
verified by banded alignment (free ends in the text). k is `rate` times m, less where short
items would leave a bound under 1; items shorter than q are not searched for by edits but
must stand as they are, between word boundaries.

The benchmark is read in blocks of bounded size, each of them against every document; items
are few by nature, documents are not moved at all. Nulls, empty texts and items without
letters or digits match nothing. Equal items are found under each of their ids. Documents
with repeated or null ids are rows of their own. Other columns are not read. Empty tables
give an empty result. Texts are whole, of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

Q = 10
#: Characters of the benchmark that are searched for in one pass over the documents.
BLOCK_CHARS = 4_000_000
_KEEP = np.array([x > 0x7F or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A for x in range(256)])


def normal(text: str | None) -> str:
    """Lower-cased words, joined by one space."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    return b" ".join(np.where(_KEEP[data], data, 32).astype(np.uint8).tobytes().split()).decode("utf-8", "replace")


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of each q-gram of an array of code points."""
    n = codes.size - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # Polynomial hashes of 1, 2, 4, ... characters, put together along the bits of q.
    power, h, done, out = np.uint64(0x9E3779B97F4A7C15), (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, None
    place = 0
    while True:
        if q & done:
            part = h[place : place + n]
            out = part.copy() if out is None else out * power + part
            place += done
        if done * 2 > q:
            break
        h = h[:-done] * power + h[done:]
        with np.errstate(over="ignore"):
            power = power * power
        done *= 2
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def budget(m: int, rate: float, q: int = Q) -> int:
    """Edits allowed in an item of m characters, so that the lemma's bound is 1 at least; -1 if m < q."""
    return min(int(rate * m), m // q - 1)


class Items:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.text = [t for _, t in items]
        self.codes = [np.array([ord(c) for c in t], dtype=np.int32) for t in self.text]
        self.k = np.array([budget(len(t), rate) for t in self.text], dtype=np.int64)
        self.bound = np.array([len(t) + 1 - Q * (k + 1) for t, k in zip(self.text, self.k, strict=True)], dtype=np.int64)
        hs = [grams(c) if k >= 0 else np.zeros(0, np.uint64) for c, k in zip(self.codes, self.k, strict=True)]
        h = np.concatenate([*hs, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hs)), [x.size for x in hs])
        place = np.concatenate([*(np.arange(x.size) for x in hs), np.zeros(0, int)])
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.keys, self.first, self.count = np.unique(self.h, return_index=True, return_counts=True)
        self.bits = max(16, min(24, int(self.keys.size * 32).bit_length()))
        self.sieve = np.zeros(1 << self.bits, dtype=bool)
        self.sieve[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.short = [(i, t) for i, t in enumerate(self.text) if t and self.k[i] < 0]


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of pattern in text on diagonals low..high, if at most k edits."""
    m, width = pattern.size, high - low + 1
    far = k + 1
    d = np.arange(low, high + 1)
    cost = np.where((d >= 0) & (d <= text.size), 0, far)  # row 0: an occurrence may start anywhere
    start = d.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        j = d + i  # text characters used
        inside = (j >= 1) & (j <= text.size)
        same = np.full(width, False)
        same[inside] = text[j[inside] - 1] == pattern[i - 1]
        best, from_ = np.where(inside, cost + ~same, far), start.copy()
        up = np.append(cost[1:], far) + 1  # an item character left out
        up_start = np.append(start[1:], 0)
        better = (up < best) & (j >= 0)
        best, from_ = np.where(better, up, best), np.where(better, up_start, from_)
        # A text character put in: costs run on to the right along the row.
        run = np.minimum.accumulate((best - steps) * (width + 1) + steps)
        source = run % (width + 1)
        value = best[source] + steps - source
        ok = j <= text.size
        cost, start = np.where(ok, np.minimum(value, far), far), from_[source]
        if (cost > k).all():
            return None
    at = int(np.argmin(cost))
    return (int(cost[at]), int(start[at]), int(d[at] + m)) if cost[at] <= k else None


def find(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of occurrences, the best of each text and item. Texts are normal."""
    out = []
    for a, b in C.chunks(texts):
        joined = "\x00".join(texts[a:b])
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        if items.keys.size:
            h = grams(codes)
            maybe = np.flatnonzero(items.sieve[(h >> np.uint64(64 - items.bits)).astype(np.int64)])
            at = np.searchsorted(items.keys, h[maybe])
            hit = at < items.keys.size
            hit[hit] = items.keys[at[hit]] == h[maybe[hit]]
            place, at = maybe[hit], at[hit]
            n = items.count[at]
            entry = np.repeat(items.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(place, n)
            item = items.item[entry]
            doc = np.searchsorted(offset, place, side="right") - 1
            # Fewer grams in common than the bound, wherever they stand: no band can reach it.
            pair = doc * len(items.ids) + item
            if (b - a) * len(items.ids) <= 1 << 22:
                common = np.bincount(pair)[pair]
            else:
                _, inverse, common = np.unique(pair, return_inverse=True, return_counts=True)
                common = common[inverse]
            keep = common >= items.bound[item]
            place, item, doc, entry = place[keep], item[keep], doc[keep], entry[keep]
            diagonal = place - items.place[entry]  # may start before its text, where the item's first characters differ
            width = items.k[item] + 1
            block = np.floor_divide(diagonal - offset[doc], width)
            keys = np.stack([np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([block, block - 1])], 1)
            if keys.size:
                keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
                count = np.diff(np.append(first, len(keys)))
                keys = keys[first]
                keep = count >= items.bound[keys[:, 1]]
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for d, i, block in keys[keep].tolist():
                    k = int(items.k[i])
                    if (d, i) not in best and (s := texts[a + d].find(items.text[i])) >= 0:
                        best[d, i] = (0, s, s + len(items.text[i]))
                    if best.get((d, i), (1,))[0] == 0:
                        continue  # nothing is better
                    low = block * (k + 1)
                    text = codes[offset[d] : offset[d + 1] - 1] if d + 1 < offset.size - 1 else codes[offset[d] :]
                    got = align(items.codes[i].astype(np.uint32), text, low, low + 2 * (k + 1) - 1, k)
                    if got and got < best.get((d, i), (k + 1, 0, 0)):
                        best[d, i] = got
                out += [(a + d, i, s, e, c) for (d, i), (c, s, e) in best.items()]
        for i, t in items.short:
            for d in range(a, b):
                at = f" {texts[d]} ".find(f" {t} ")
                if at >= 0:
                    out.append((d, i, at, at + len(t), 0))
    return out


FOUND = "item_id long, start int, end int, edits int"


def _searcher(held):
    def run(batches):
        items = held.value
        for batch in batches:
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            found = find(texts, items)
            ids = batch.column("id").take(pa.array([f[0] for f in found], pa.int64()))
            columns = [pa.array([items.ids[f[1]] for f in found], pa.int64())] + [pa.array([f[k] for f in found], pa.int32()) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "item_id", "start", "end", "edits"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, rate: float):
    """The benchmark's items in blocks of about BLOCK_CHARS, each a broadcast. An item is whole, whatever its length."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()  # about BLOCK_CHARS at most
        yield spark.sparkContext.broadcast(Items([(r["item"], t) for r in part if (t := normal(r["text"]))], rate))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08) -> DataFrame:
    """(id, item_id, start, end, edits): the best occurrence of each item in each document, by places in the normal text."""
    rows = C.small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, rate):
        found = rows.mapInArrow(_searcher(items), f"id {kind}, {FOUND}")
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08) -> DataFrame:
    """The rows of docs that hold no item, as they are; each is judged where it is read."""

    def keeper(items):
        def run(batches):
            for batch in batches:
                texts = [normal(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                clean = np.ones(len(texts), dtype=bool)
                clean[[f[0] for f in find(texts, items.value)]] = False
                yield batch.filter(pa.array(clean))
            C.trim()

        return run

    C.small_batches(docs)
    for items in _blocks(benchmark, item_col, item_text_col, rate):
        docs = docs.mapInArrow(keeper(items), docs.schema)
    return docs
