"""SentencePiece encoding and decoding by a relational lattice of pieces.

A text is cut into words that no piece crosses. For the commonest words of the corpus
(`common_words` at most, which bounds the broadcast) the lattice is relational: substrings up
to the longest piece are exploded, joined to the piece table, grouped by word and folded by
Spark's higher-order `aggregate`. Rarer words, which a join would have to carry along with
every occurrence, go through the same lattice and fold where their document is read, with
a bounded memory of words already done. Both give the same ids, so the bound changes no result.

The fold follows the model: for unigram models it is Viterbi over piece scores; for BPE models
the state is a set of cuts, and the best-scored edge over one cut is taken, leftmost first, until none is left, since
Viterbi over BPE scores gives other ids than the model's own algorithm.

Null texts have null ids and round_trip null; empty texts have no ids. Characters without a
piece become byte pieces, or the unknown id if the model has none. `round_trip` tells
whether decoding gives the text back, which the escape character U+2581 in a text prevents.
Texts and words are whole, of any length. Ids may be null or repeated: one result row for each
row. Other columns are not read. An empty table gives an empty result. Models whose
normaliser isn't the identity are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, chunks, cut, mix, powers, small_batches, trim

SPACE = "▁"
WORD = f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
NORMAL, UNKNOWN, BYTE, UNIGRAM, BPE = 1, 2, 6, 1, 2
#: Words remembered in a task.
REMEMBERED = 50_000
#: Characters of a word whose places fit the bits of a long; longer words go where their document is read.
LONGEST = 60
NOTHING = -1e30


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        elif kind == 1:
            at += 8
        else:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int = UNIGRAM
    prefix: bool = True
    id_of: dict[str, int] = field(default_factory=dict)
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0

    def __post_init__(self):
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.id_of):
            raise ValueError("a piece crosses words")
        self.longest = max(map(len, self.id_of), default=1)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, algorithm, normal = [], [], [], UNIGRAM, {}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one.get(1, b"").decode())
                scores.append(one.get(2, 0.0))
                kinds.append(one.get(3, NORMAL))
            elif number == 2:
                algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(1, b"") not in (b"identity", b"") or normal.get(2, b"") or normal.get(4, 1) or algorithm not in (UNIGRAM, BPE):
            raise ValueError("only models with the identity normaliser are supported")
        return cls(pieces, scores, kinds, algorithm, bool(normal.get(3, 1)))

    def spell(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def escape(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def decode(self, ids: list[int]) -> str:
        text = "".join([self.pieces[i] if self.kinds[i] != BYTE else "\x00" + self.pieces[i] for i in ids])
        if self.byte_ids:
            text = re.sub("(?:\x00<0x..>)+", lambda m: bytes(int(x, 16) for x in re.findall("<0x(..)>", m[0])).decode("utf-8", "replace"), text)
        text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Encoder:
    """The lattice and its fold for single words."""

    def __init__(self, model: Model):
        self.model = model
        self.score = {p: model.scores[i] for p, i in model.id_of.items()}
        self.fold = self.merge if model.algorithm == BPE else self.viterbi

    def merge(self, word: str) -> list[str]:
        if len(word) > 48:
            return self.merge_long(word)
        parts, score = list(word), self.score.get
        while len(parts) > 1:
            best, at = NOTHING, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge_long(self, word: str) -> list[str]:
        """As merge, by a heap and a linked list."""
        parts, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def viterbi(self, word: str) -> list[str]:
        lowest = min(self.score.values(), default=0.0) - 10.0  # of a character without a piece
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            at = (NOTHING, 0)
            for start in range(max(0, end - self.model.longest), end):
                s = self.score.get(word[start:end], lowest if end - start == 1 else None)
                if s is not None and best[start][0] + s > at[0]:
                    at = (best[start][0] + s, start)
            best.append(at)
        parts, end = [], len(word)
        while end:
            parts.append(word[best[end][1] : end])
            end = best[end][1]
        return parts[::-1]

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.fold(word):
            i = self.model.id_of.get(p)
            if i is None:
                out += self.model.spell(p)
            else:
                out.append(i)
        return out


# -- the relational lattice ----------------------------------------------------------------


def escaped(text: Column, prefix: bool) -> Column:
    space = F.lit(SPACE if prefix else "")
    return F.when(F.length(text) > 0, F.concat(space, F.replace(text, F.lit(" "), F.lit(SPACE)))).otherwise("")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): the pieces of each word, best score first, then leftmost. words: distinct, of at most LONGEST characters.

    Places between characters are bits: an edge has those of its two ends, and those within.
    """
    starts = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start")))).alias("n"))
    spans = spans.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("n")))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    edge = F.expr(
        "named_struct('far', far, 'start', start, 'n', n, 'ends', shiftleft(1L, start) | shiftleft(1L, start + n), 'within', shiftleft(shiftleft(1L, n - 1) - 1L, start + 1), 'id', coalesce(id, -1 - ascii(piece)))"
    )
    return edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def _merged(edges: Column, word: Column) -> Column:
    """BPE: ids of the word. The state is the bits of the places where it is still cut.

    Each step takes the first edge of which both ends are cuts, with one cut within, and joins its two parts.
    """
    def ready(cuts: Column, e: Column) -> Column:
        return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["within"])) == 1)

    def step(cuts: Column, _: Column) -> Column:
        best = F.get(F.filter(edges, lambda e: ready(cuts, e)), 0)
        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(best["within"], F.lit(0).cast("long"))))

    def path(cuts: Column) -> Column:
        taken = F.filter(edges, lambda e: cuts.bitwiseAND(e["ends"].bitwiseOR(e["within"])) == e["ends"])
        return F.transform(F.array_sort(F.transform(taken, lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id")))), lambda e: e["id"])

    whole = F.expr("shiftleft(1L, length(word) + 1) - 1L")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), whole, step, path)


def _best_path(edges: Column, word: Column, lowest: float) -> Column:
    """Unigram: ids of the word's best path (Viterbi). The state holds score and path of every place so far."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("path")))

    def step(state: Column, end: Column) -> Column:
        arriving = F.filter(edges, lambda e: e["start"] + e["n"] == end)
        ways = F.transform(arriving, lambda e: F.struct((F.element_at(state, e["start"] + 1)["score"] + F.when(e["id"] < 0, F.lit(lowest)).otherwise(-e["far"])).alias("score"), F.negative(e["start"]).alias("order"), F.concat(F.element_at(state, e["start"] + 1)["path"], F.array(e["id"])).alias("path")))
        return F.concat(state, F.transform(F.array(F.array_max(ways)), lambda best: F.struct(best["score"].alias("score"), best["path"].alias("path"))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step, lambda state: F.element_at(state, -1)["path"])


def word_table(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of distinct words, in DataFrame operations only. A character without a piece is -1 less its code point."""
    rows = [(p, i, -float(model.scores[i])) for p, i in model.id_of.items()]
    pieces = words.sparkSession.createDataFrame(rows, "piece string, id int, far double")  # as large as the model's vocabulary
    fold = _merged(F.col("edges"), F.col("word")) if model.algorithm == BPE else _best_path(F.col("edges"), F.col("word"), -max((s for _, _, s in rows), default=0.0) - 10.0)
    return lattice(words, pieces, model.longest).select("word", fold.alias("ids"))


def common(texts: DataFrame, model: Model, most: int) -> DataFrame:
    """(word): at most `most` of the corpus's commonest words: all that occur oftener than the rest."""
    words = texts.select(F.explode(F.regexp_extract_all(escaped(F.col("text"), model.prefix), F.lit(WORD), F.lit(0))).alias("word"))
    counted = cut(words.groupBy("word").agg(F.count("*").alias("n")).where(f"n > 1 and length(word) <= {LONGEST}"))
    sizes = counted.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("words"))
    least, total = None, 0
    for r in sorted(sizes.toLocalIterator(), key=lambda r: -r["n"]):
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return counted.where(F.col("n") >= least).select("word") if least else counted.where("false").select("word")


# -- texts as bytes ------------------------------------------------------------------------


def split_words(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places where words start (see WORD), in bytes in which a space is a space. begins: where texts do."""
    space, line = data == 32, data == 10
    start = line | (space & ~np.concatenate([[False], space[:-1]])) | (~space & np.concatenate([[True], line[:-1]]))
    start[begins[begins < data.size]] = True
    return np.flatnonzero(start)


def word_keys(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that start there and end where the next one starts."""
    power, inverse = powers(data.size)
    total = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: data.size], out=total[1:])
    return mix((total[np.append(start[1:], data.size)] - total[start]) * inverse[start]) if start.size else np.zeros(0, np.uint64)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(first - (ends - count), count)


class WordIds:
    """Word hashes, sorted, and their ids. Lookups start at the first key of the same leading bits."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys, kind="stable")
        first = (np.cumsum(count) - count)[order]
        self.keys, self.count = np.append(keys[order], np.uint64(2**64 - 1)), count[order]
        self.ids = ids[ragged(first, self.count)].astype(np.int32)
        self.first = np.cumsum(self.count) - self.count
        self.shift = np.uint64(64 - max(4, int(keys.size).bit_length()))
        self.at = np.searchsorted(self.keys[:-1], np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        at = self.at[(keys >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.keys[at] < keys)
        while todo.size:
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < keys[todo]]
        return np.where((self.keys[at] == keys) & (at < self.count.size), at, -1)


def _packed(model: Model):
    """Hashes, numbers of ids and ids of the word table's rows, as one row for each batch."""

    def run(batches):
        for batch in batches:
            words = [w.replace(SPACE, " ").encode() for w in batch.column("word").to_pylist()]
            size = np.array([len(w) for w in words], dtype=np.int64)
            keys = word_keys(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(size) - size)
            ids = [[y for i in x for y in ([i] if i >= 0 else model.spell(chr(-1 - i)))] for x in batch.column("ids").to_pylist()]
            count = np.array([len(x) for x in ids], dtype=np.int32)
            flat = np.array([i for x in ids for i in x], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, count, flat)], names=["keys", "count", "ids"])

    return run


class Spelling:
    """The bytes of each piece, for decoding many ids at once."""

    def __init__(self, model: Model):
        own = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.count = np.array([len(x) for x in own], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.bytes = np.frombuffer(b"".join(own), dtype=np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.first[ids], self.count[ids])]


def code(texts: list[str], encoder: Encoder, table: WordIds, spelling: Spelling, memory: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of ids of each text, whether decoding gives the text back)."""
    model = encoder.model
    raw = [((" " if model.prefix and t else "") + t).encode("utf-8", "replace") for t in texts]
    if marked := [SPACE in t for t in texts]:
        raw = [x.replace(SPACE.encode(), b" ") if m else x for x, m in zip(raw, marked, strict=True)]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    begins = np.cumsum(size) - size
    buffer = b"".join(raw)
    data = np.frombuffer(buffer, dtype=np.uint8)
    start = split_words(data, begins[size > 0])
    at = table.find(word_keys(data, start))
    known = at >= 0
    count = np.zeros(start.size, dtype=np.int64)
    count[known] = table.count[at[known]]
    rare = np.flatnonzero(~known)
    end = np.append(start[1:], data.size)
    found = []
    for a, b in zip(start[rare].tolist(), end[rare].tolist(), strict=True):
        w = buffer[a:b]
        got = memory.get(w)
        if got is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            got = memory[w] = np.array(encoder.ids(w.decode().replace(" ", SPACE)), dtype=np.int32).tobytes()  # a third of a list's memory
        found.append(got)
    count[rare] = [len(x) // 4 for x in found]
    first = np.zeros(start.size, dtype=np.int64)
    first[known] = table.first[at[known]]
    extra = np.frombuffer(b"".join(found), dtype=np.int32)
    first[rare] = np.cumsum(count[rare]) - count[rare]
    place, from_table = ragged(first, count), np.repeat(known, count)
    ids = np.empty(place.size, dtype=np.int32)
    ids[from_table] = table.ids[place[from_table]]
    ids[~from_table] = extra[place[~from_table]]
    total = np.concatenate([[0], np.cumsum(count)])
    edge = total[np.searchsorted(start, np.append(begins, data.size))]
    n = np.diff(edge)
    back = spelling.spell(ids)
    sized = np.concatenate([[0], np.cumsum(spelling.count[ids])])
    if (np.diff(sized[edge]) == size).all():
        wrong = np.searchsorted(begins + size, np.flatnonzero(back != data), side="right")
        good = np.ones(len(texts), dtype=bool)
        good[wrong] = False
        good &= ~np.array(marked, dtype=bool)
    else:  # an unknown character without bytes
        good = np.array([model.decode(ids[a:b].tolist()) == t for a, b, t in zip(edge[:-1], edge[1:], texts, strict=True)], dtype=bool)
    return ids, n, good


def _encoder(model: Model, known):
    def run(batches):
        encoder, spelling, table, memory = Encoder(model), Spelling(model), known.value, {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                none = np.array([t is None for t in texts[a:b]], dtype=bool)
                ids, n, good = code([t or "" for t in texts[a:b]], encoder, table, spelling, memory)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids), mask=pa.array(none)), pa.array(good, mask=none)], names=["id", "ids", "round_trip"])
        trim()

    return run


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", common_words: int = 1_000_000) -> DataFrame:
    """(id, ids, n_ids, round_trip) of every row."""
    spark: SparkSession = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # About 30 bytes for each of common_words at most.
    parts = word_table(common(rows, model, common_words), model).mapInArrow(_packed(model), "keys binary, count binary, ids binary").collect()
    held = WordIds(*(np.frombuffer(b"".join(bytes(r[c]) for r in parts), dtype=kind) for c, kind in (("keys", np.uint64), ("count", np.int32), ("ids", np.int32))))
    del parts
    coded = rows.mapInArrow(_encoder(model, spark.sparkContext.broadcast(held)), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, round_trip boolean")
    return coded.select(F.col("id").alias(id_col), "ids", F.when(F.col("ids").isNull(), None).otherwise(F.size("ids")).alias("n_ids"), "round_trip")


def decode(coded: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """coded with the text of its ids. Null ids give a null text."""

    def run(batches):
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            at = batch.schema.get_field_index(out_col)
            batch = batch.drop_columns([out_col]) if at >= 0 else batch
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    kept = coded.drop(out_col)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())]))
