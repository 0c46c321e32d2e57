"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

1. Every window of `length` bytes has an anchor: its 48-byte gram of the least hash. Windows of one
   text that follow each other and have the same anchor are a segment. Equal windows have equal
   anchors, so all places of a string that stands twice are in segments of one anchor.
2. Segments are counted by (anchor, contents) inside the tasks and then globally. Anchors that stand once are out.
   Of equal segments one is looked up, with its count; so copies of a text cost no more than two.
3. Segments of an anchor go to one task. A task transforms a quarter of a megabyte of segments at once, or all of an anchor:
   suffixes are sorted, and neighbours in that order whose next character to the left is the same are
   extended breadth-first: two neighbours share l + 1 bytes unless one of those between them shares less than l.
   Common prefixes are found by increasing length, and the search stops at `length` or when nothing new was found. What
   is left shares `length` bytes or more; a window is repeated if its interval holds two places.
4. An anchor of more than 8192 different segments is dealt out window by window, by contents.
5. Repeated windows go back to all segments of the same contents, and to their texts.

Texts are UTF-8 bytes; strings don't cross texts; overlaps count, and all are judged on the input. Null texts are empty.
Equal rows are places of their own and have equal results. Ids may be null. Texts are read whole, of any length, in
sections of 4 MB. Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

GRAM = 48
#: Bytes of a text that are read at once, and of texts that are read together.
SECTION, TOGETHER = 1 << 22, 1 << 18
#: Segments that a task counts together.
HELD = 300_000
#: Bytes of a transform, and different segments of an anchor that go into one.
BLOCK, ANCHOR = 1 << 18, 8192
#: Columns of a segment; place is its start, times 2^20, and its windows.
SEGMENT = ["anchor", "seg", "k1", "k2", "place"]
_LOW = np.uint64((1 << 24) - 1)


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, contents, start, windows) of all segments of the texts that stand in data up to ends; start counts in data."""
    n = data.size - length + 1
    gram = min(GRAM, length)
    power, inverse = C.powers(data.size + 1)
    total = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(C._BYTE[data] * power[: data.size], out=total[1:])
    grams = C.mix((total[gram:] - total[:-gram]) * inverse[: data.size - gram + 1])
    least = (grams & ~_LOW) | np.arange(grams.size, dtype=np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: least.size - (width - size)], least[width - size :])
    at = (least & _LOW).view(np.int64)  # of each window, the place of its anchor
    inside = np.ones(n, dtype=bool)
    for end in ends[:-1].tolist():
        inside[end - length + 1 : end] = False
    change = np.ones(n, dtype=bool)
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    many = np.diff(np.append(first, n))
    good = inside[first]
    first, many = first[good], many[good]
    text = np.searchsorted(ends, first, side="right")
    own = (total[first + many + length - 1] - total[first]) * inverse[first]
    own = C.mix(own + many.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (at[first] - first).astype(np.uint64))
    return text, grams[at[first]].view(np.int64), own.view(np.int64), first, many


def _each(batch: pa.RecordBatch, length: int):
    """Segments of a batch's texts as arrays in the order of SEGMENT."""
    k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
    texts = [t or b"" for t in batch.column("text").to_pylist()]

    def found(parts: list[bytes], rows: list[int], starts: list[int]):
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        text, anchor, seg, first, many = segments(data, ends, length)
        begins = np.concatenate([[0], ends])[text]
        row, start = np.array(rows)[text], np.array(starts)[text] + first - begins
        return anchor, seg, k1[row], k2[row], (start << 20) + many

    parts, rows, starts, size = [], [], [], 0
    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, SECTION):
            part = text[at : at + SECTION + length - 1]
            parts.append(part)
            rows.append(row)
            starts.append(at)
            size += len(part)
            if size >= TOGETHER:
                yield found(parts, rows, starts)
                parts, rows, starts, size = [], [], [], 0
    if parts:
        yield found(parts, rows, starts)


def _batch(arrays, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _members(length: int):
    def run(batches):
        for batch in batches:
            for found in _each(batch, length):
                yield _batch(found, SEGMENT)

    return run


def _counted(length: int):
    """Different segments of a task, with the number of their places there and one of them."""

    def together(held: list) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        anchor, seg = columns[0][order], columns[1][order]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])]))
        n = np.diff(np.append(first, order.size))
        return _batch([*(c[order[first]] for c in columns), n], [*SEGMENT, "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for found in _each(batch, length):
                held.append(found)
                size += found[0].size
                if size >= HELD:
                    yield together(held)
                    held, size = [], 0
        if size:
            yield together(held)

    return run


def _contents(length: int, most: int):
    """The bytes of a text's sought segments; of crowded anchors, each window by itself. offset: first window within the segment."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text, sought = batch.column("text")[k].as_py(), batch.column("sought")[k].values
                out = []
                for anchor, seg, place, n, crowd in zip(*(sought.field(c).to_pylist() for c in ("anchor", "seg", "place", "n", "crowd")), strict=True):
                    start, many = place >> 20, place & ((1 << 20) - 1)
                    if crowd <= most:
                        out.append((anchor, anchor, seg, 0, n, text[start : start + many + length - 1]))
                    else:
                        for w in range(many):
                            window = text[start + w : start + w + length]
                            out.append((anchor ^ _digest(window), anchor, seg, w, n, window))
                        if len(out) > 50_000:
                            yield _segment_rows(out)
                            out = []
                if out:
                    yield _segment_rows(out)

    return run


def _digest(window: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(window) - (1 << 63)


CONTENTS = ["route", "anchor", "seg", "offset", "n", "bytes"]


def _segment_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k == 5 else pa.int64()) for k in range(6)], names=CONTENTS)


def suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of data, read in a circle, in the order of the depth bytes or more that begin there."""
    n = data.size
    wide = np.uint64(max(1, (n - 1).bit_length()))
    rank = np.zeros(n, dtype=np.uint64)
    for k in range(4):
        rank = (rank << np.uint64(8)) | np.roll(data, -k)
    size, place = 4, np.arange(n, dtype=np.uint64)
    while True:
        if size == 4 and wide <= 32 or 3 * wide <= 64:  # keys with their places are sorted faster than places by keys
            ordered = np.sort((rank << wide) | place)
            order = (ordered & ((np.uint64(1) << wide) - np.uint64(1))).view(np.int64)
            ordered >>= wide
        else:
            order = np.argsort(rank)
            ordered = rank[order]
        if size >= depth:
            return order
        dense = np.empty(n, dtype=np.uint64)
        dense[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        rank = (dense << wide) | np.roll(dense, -size)
        size *= 2


def expansion(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, common prefix of each with the one before, or length if it is that or more)."""
    order = suffixes(data, length + 1)
    left = data[order - 1]  # the transform
    back = np.argsort(left, kind="stable")  # row of the transform that each suffix extends to the left
    # back's order is that of one byte more, which agrees with order on prefixes of up to length bytes
    n = data.size
    prefix = np.full(n, length, dtype=np.int16)
    known = np.ones(n, dtype=bool)
    known[1:] = left[back[1:]] != left[back[:-1]]
    prefix[known] = 0
    fresh, depth = np.flatnonzero(known), 1
    open_ = np.flatnonzero(~known)
    low, high = back[open_ - 1], back[open_]
    while True:
        # The new intervals, [first, end) each
        bounds = np.flatnonzero(prefix < length)
        end = fresh[fresh > 0]
        first = bounds[np.searchsorted(bounds, end) - 1]
        if depth == length or 16 * (end - first).sum() < n:
            break
        # While they hold much of the text, all open neighbours are looked at
        before = np.zeros(n, dtype=np.int32)
        before[fresh] = 1
        np.cumsum(before, out=before)
        hit = before[high] != before[low]
        fresh = open_[hit]
        prefix[fresh] = depth
        open_, low, high = open_[~hit], low[~hit], high[~hit]
        depth += 1
    # Then the new intervals alone: each is extended by every byte that stands left of it
    row = np.empty(n, dtype=np.int64)
    row[back] = np.arange(n)
    while depth < length and first.size:
        size = end - first
        inside = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        parent = np.repeat(np.arange(size.size), size)
        longer = row[inside]
        by = np.argsort(longer)
        longer, parent = longer[by], parent[by]
        begins = np.ones(longer.size, dtype=bool)
        begins[1:] = (longer[1:] != longer[:-1] + 1) | (parent[1:] != parent[:-1]) | (prefix[longer[1:]] == 0)
        at = np.flatnonzero(begins)
        first, end = longer[at], longer[np.append(at[1:], longer.size) - 1] + 1
        new = prefix[np.minimum(end, n - 1)] == length
        new &= end < n
        first, end = first[new], end[new]
        prefix[end] = depth
        depth += 1
    return order[back] - 1, prefix


def repeated(parts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each part, its windows that stand in the parts twice or more, counted with the parts' weights."""
    data = np.frombuffer(b"".join(parts) + bytes(length + 8), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    many = sizes - length + 1
    weight = np.zeros(data.size, dtype=np.int8)
    for begin, n, w in zip(begins, many, weights, strict=False):
        weight[begin : begin + n] = min(w, 2)
    places, prefix = expansion(data, length)
    interval = np.cumsum(prefix < length) - 1
    heavy = np.bincount(interval, weights=weight[places]) >= 2
    out = np.zeros(data.size, dtype=bool)
    out[places] = heavy[interval]
    return [np.flatnonzero(out[b : b + n]) for b, n in zip(begins, many, strict=False)]


def _expand(length: int, block: int):
    """Sorted contents to (anchor, seg, runs): first and last repeated windows of each run."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (anchor, seg, offset, _, _), windows in zip(held, repeated([h[4] for h in held], [h[3] for h in held], length), strict=True):
            if windows.size:
                split = np.flatnonzero(np.diff(windows) > 1)
                runs = np.stack([windows[np.concatenate([[0], split + 1])], windows[np.concatenate([split, [windows.size - 1]])]], 1).ravel()
                rows.append((anchor, seg, (runs + offset).tolist()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["anchor", "seg", "runs"])

    def run(batches):
        held, size, last, seen = [], 0, None, None
        for batch in batches:
            for route, *own, n, data in zip(*(batch.column(c).to_pylist() for c in CONTENTS), strict=True):
                if route != last and size >= block:
                    yield out(held)
                    held, size = [], 0
                if (route, *own) != seen:  # equal rows of the table bring the same segment
                    held.append((*own, n, data))
                    size += len(data)
                last, seen = route, (route, *own)
        if held:
            yield out(held)

    return run


def _remove(length: int):
    def run(batches):
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                text = text or b""
                sizes.append(len(text))
                own = []
                if runs.is_valid:
                    starts, pairs = (runs.values.field(c) for c in ("start", "runs"))
                    each = np.repeat(starts.to_numpy(), pairs.value_lengths().to_numpy())
                    flat = (pairs.flatten().to_numpy() + each).reshape(-1, 2)
                    flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
                    for first, last in flat.tolist():
                        if own and first <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], last + length)
                        else:
                            own.append([first, last + length])
                spans.append([{"start": a, "end": b} for a, b in own])
                at, rest = 0, []
                for a, b in own:
                    rest.append(text[at:a])
                    at = b
                kept.append(b"".join([*rest, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans: array of start and end of removed bytes, kept: the remaining bytes) of every row."""
    rows = C.small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *C.row_keys(F.col(id_col), F.col(text_col)))
    read = rows.select("k1", "k2", "text")
    longs = lambda names: ", ".join(f"{c} long" for c in names)
    counted = read.mapInArrow(_counted(length), longs([*SEGMENT, "n"])).repartition("anchor")
    distinct = counted.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "place")))
    crowds = distinct.withColumn("places", F.sum("n").over(W.partitionBy("anchor"))).withColumn("crowd", F.count("*").over(W.partitionBy("anchor")))
    sought = crowds.where("places > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "seg", "place", "n", "crowd")).alias("sought"))  # of one text
    contents = rows.join(sought, ["k1", "k2"]).mapInArrow(_contents(length, ANCHOR), longs(CONTENTS[:-1]) + ", bytes binary")
    dealt = contents.repartition("route").sortWithinPartitions("route", "anchor", "seg", "offset")
    found = dealt.mapInArrow(_expand(length, BLOCK), "anchor long, seg long, runs array<long>")
    members = read.mapInArrow(_members(length), longs(SEGMENT)).join(found, ["anchor", "seg"])
    own = members.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.shiftright("place", 20).alias("start"), "runs")).alias("runs"))  # of one text, or of equal rows
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(own, ["k1", "k2"], "left").mapInArrow(_remove(length), f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


#: DuckDB SQL for the query over documents. It hashes every window of 200 bytes, as 400 hexadecimal digits.
ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT r, unnest(range(0, length(h) // 2 - 199)) AS i FROM d
), windows AS (
  SELECT r, i, md5(substr(h, (2 * i + 1)::INTEGER, 400)) AS k FROM starts JOIN d USING (r)
), twice AS (
  SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 200 AS fresh FROM windows JOIN twice USING (k)
), numbered AS (
  SELECT r, i, sum(fresh::INTEGER) OVER (PARTITION BY r ORDER BY i) AS n FROM gone
), spans AS (
  SELECT r, n, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, n
), before AS (
  SELECT r, n, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY n), 0) AS kept_from FROM spans
), pieces AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, (2 * kept_from + 1)::INTEGER, (2 * (a - kept_from))::INTEGER), '' ORDER BY n) AS kept FROM before JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::INTEGER))) AS kept_sha256
FROM d LEFT JOIN pieces USING (r)"""
