"""Toxicity by a linear-chain conditional random field over words.

Training happens in one task, on a bounded sample of labelled documents: `max_train` documents and
`max_chars` characters of each label at most (but for one text), chosen by a hash of id and text. The driver sees
the model alone. Labels mark documents, so token labels come first:
words, and word beginnings of 4 and 6 bytes, that are significantly commoner in documents
labelled 1 mark the tokens. One document of each group of near copies counts. The CRF (tags
O and T; features word, beginnings, transitions) is then fitted to these tags by gradient
ascent on the conditional likelihood, on stretches of SEGMENT words; those without evidence differ in
length alone and are counted by it.

Scoring: only words with a learned feature have evidence; stretches between them are powers
of the transition matrix, so forward and backward run over the few words that matter.
Marginals of T give the offending offsets (characters of the text, marginal >= 0.5) and, by a
logistic calibration of their sum and maximum, the document's score.

Labels, language, source and ids are never inputs of a score. Null and empty texts get the
score of a document without evidence. Rows with a null id are scored; their held_out is false.
Conflicting labels of an id count as toxic; null labels don't count. Repeated rows get one result
each. Without labels of both kinds every score is 0. Other columns of the input are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIXES = (4, 6)
SEGMENT = 64


def token_features(w: C.Words) -> list[np.ndarray]:
    """Feature keys of each word: itself and its beginnings; 0 for none."""
    return [w.hash, *w.prefix.values()]


def near_copy_representatives(texts: list[str]) -> np.ndarray:
    """Indices of one text of each group that shares a MinHash band."""
    seen: set[tuple[int, int]] = set()
    out = []
    for first, last in C.chunks(texts):
        docs, hashes = C.shingles(texts[first:last])
        for i, row in enumerate(C.band_keys(C.minhash(docs, hashes, last - first, 32), 4)):
            own = {(b, int(x)) for b, x in enumerate(row)}
            if not own & seen:
                out.append(first + i)
            seen |= own
    return np.array(out, dtype=int)


def indicators(texts: list[str], toxic: np.ndarray, least_docs: int = 3, least_ratio: float = 3.0, z: float = 3.0) -> np.ndarray:
    """Sorted keys of features that are significantly commoner in toxic documents.

    The log odds ratio must be `least_ratio` at least, and z / 2 standard errors above 0.
    """
    keys, t, c = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for first, last in C.chunks(texts):
        words = C.Words(texts[first:last], PREFIXES)
        pairs = np.unique(np.concatenate([np.stack([f, words.doc.astype(np.uint64)], 1)[f != 0] for f in token_features(words)]), axis=0)
        bad = toxic[first + pairs[:, 1].astype(int)]
        keys, inverse = np.unique(np.concatenate([keys, pairs[:, 0]]), return_inverse=True)
        t = np.bincount(inverse, np.concatenate([t, bad]), len(keys))
        c = np.bincount(inverse, np.concatenate([c, ~bad]), len(keys))
    nt, nc = toxic.sum(), (~toxic).sum()
    odds = np.log((t + 0.5) / (nt - t + 0.5)) - np.log((c + 0.5) / (nc - c + 0.5))
    error = np.sqrt(1 / (t + 0.5) + 1 / (nt - t + 0.5) + 1 / (c + 0.5) + 1 / (nc - c + 0.5))
    return keys[(t >= max(least_docs, 0.01 * nt)) & (odds >= least_ratio) & (odds >= z * error / 2) & (t > c)]


class Crf:
    """Two tags. Emission of T minus that of O: bias + weights of a word's features."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.weight, self.bias, self.trans = keys, np.zeros(len(keys)), -4.0, np.zeros((2, 2))
        self.calibration = np.array([-3.0, 1.0, 4.0])

    def columns(self, words: C.Words) -> np.ndarray:
        """(words, features) positions in keys, len(keys) for none."""
        out = []
        size = 1 << 16
        sieve = np.zeros(size, dtype=bool)
        sieve[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        for f in token_features(words):
            col = np.full(f.size, len(self.keys), dtype=np.int32)
            maybe = np.flatnonzero(sieve[(f >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(self.keys, f[maybe])
            hit = at < len(self.keys)
            hit[hit] = self.keys[at[hit]] == f[maybe[hit]]
            col[maybe[hit]] = at[hit]
            out.append(col)
        return np.stack(out, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, scale: np.ndarray, steps: int = 80, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Full-batch Adam. x: features of the words of each segment, y: their tags, mask: which are there, scale: how often."""
        none, n = len(self.keys), len(x)
        theta = np.concatenate([np.zeros(none), [self.bias], np.zeros(4)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        both = mask[:, 1:] & mask[:, :-1]
        total = (mask.sum(1) * scale).sum()
        for step in range(1, steps + 1):
            w = np.append(theta[:none], 0.0)
            e = w[x].sum(2) + theta[none]
            t = theta[none + 1 :].reshape(2, 2)
            alpha, beta = np.zeros((n, SEGMENT, 2)), np.zeros((n, SEGMENT, 2))
            alpha[:, 0, 1] = e[:, 0]
            for k in range(1, SEGMENT):
                nxt = np.logaddexp(alpha[:, k - 1, 0, None] + t[0], alpha[:, k - 1, 1, None] + t[1])
                nxt[:, 1] += e[:, k]
                alpha[:, k] = np.where(mask[:, k, None], nxt, alpha[:, k - 1])
            for k in range(SEGMENT - 2, -1, -1):
                nxt = np.stack([np.logaddexp(t[a, 0] + beta[:, k + 1, 0], t[a, 1] + e[:, k + 1] + beta[:, k + 1, 1]) for a in (0, 1)], 1)
                beta[:, k] = np.where(mask[:, k + 1, None], nxt, 0.0)
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
            diff = (y * mask - p1) * scale[:, None]
            grad = np.zeros_like(theta)
            grad[:none] = np.bincount(x.ravel(), np.repeat(diff.ravel(), x.shape[2]), none + 1)[:none]
            grad[none] = diff.sum()
            for a in (0, 1):
                for b in (0, 1):
                    seen = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum(1)
                    want = (np.exp(alpha[:, :-1, a] + t[a, b] + (e[:, 1:] if b else 0) + beta[:, 1:, b] - z[:, None]) * both).sum(1)
                    grad[none + 1 + 2 * a + b] = ((seen - want) * scale).sum()
            grad = grad / total * 1000 - l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weight, self.bias, self.trans = theta[:none], float(theta[none]), theta[none + 1 :].reshape(2, 2)

    def marginals(self, gap_before: np.ndarray, emission: np.ndarray, gap_after: int) -> np.ndarray:
        """P(T) of words with evidence, each after gap_before words without any."""
        step = np.exp(self.trans) * np.array([1.0, np.exp(self.bias)])  # from row to column, over a word without evidence
        step /= step.max()
        values, vectors = np.linalg.eig(step)
        inverse = np.linalg.inv(vectors)
        values = (values / np.abs(values).max()).real
        vectors, inverse = vectors.real, inverse.real

        def over(n):
            return (vectors * values**n) @ inverse

        arrive = np.exp(self.trans)
        n = len(emission)
        emission = np.clip(emission, -60, 60)
        forward, a = np.zeros((n, 2)), None
        for k in range(n):
            g = int(gap_before[k])
            if a is None:
                a = np.ones(2) if g == 0 else (np.array([1.0, np.exp(self.bias)]) @ over(g - 1)) @ arrive
            else:
                a = a @ over(g) @ arrive
            a = a * np.array([1.0, np.exp(emission[k])])
            a = np.maximum(a / a.sum(), 0)
            forward[k] = a
        b = over(int(gap_after)) @ np.ones(2)
        out = np.zeros(n)
        for k in range(n - 1, -1, -1):
            joint = forward[k] * b
            out[k] = joint[1] / joint.sum()
            b = over(int(gap_before[k])) @ arrive @ (np.array([1.0, np.exp(emission[k])]) * b) if k else b
            b = b / b.sum()
        return out

    def tag(self, words: C.Words):
        """(document, positions of its words with evidence, their marginals), for documents with evidence."""
        cols = self.columns(words)
        active = np.flatnonzero((cols < len(self.keys)).any(1))
        if not active.size:
            return
        emission = np.append(self.weight, 0.0)[cols[active]].sum(1) + self.bias
        count = np.bincount(words.doc, minlength=words.n)
        first = np.cumsum(count) - count
        docs = words.doc[active]
        at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        for a, b in zip(at, np.append(at[1:], docs.size), strict=True):
            d = docs[a]
            place = active[a:b] - first[d]
            gaps = np.diff(np.concatenate([[-1], place])) - 1
            yield int(d), active[a:b], self.marginals(gaps, emission[a:b], count[d] - 1 - place[-1])

    def score(self, marginals: np.ndarray) -> float:
        z = self.calibration @ np.array([1.0, np.log1p(marginals.sum()), marginals.max() if marginals.size else 0.0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def calibrate(self, sums: np.ndarray, tops: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        x = np.stack([np.ones_like(sums), np.log1p(sums), tops], 1)
        c = np.zeros(3)
        ridge = np.diag([1e-6, 0.3, 0.3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            g = x.T @ (weight * (toxic - p)) - ridge @ c
            h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
            c = c + np.linalg.solve(h, g)
        self.calibration = c


def segments(cols: np.ndarray, tags: np.ndarray, doc: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags and mask of the segments with evidence, and how many of the others have each length."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    place = np.arange(doc.size) - np.repeat(starts, np.diff(np.append(starts, doc.size)))
    segment = np.cumsum(place % SEGMENT == 0) - 1
    has = np.zeros(segment[-1] + 1, dtype=bool)
    has[segment[(cols < none).any(1)]] = True
    row, n = np.cumsum(has) - 1, has.sum()
    keep = has[segment]
    r, p = row[segment[keep]], place[keep] % SEGMENT
    x, y, mask = np.full((n, SEGMENT, cols.shape[1]), none, dtype=np.int32), np.zeros((n, SEGMENT), dtype=np.int8), np.zeros((n, SEGMENT), dtype=bool)
    x[r, p], y[r, p], mask[r, p] = cols[keep], tags[keep], True
    return x, y, mask, np.bincount(np.bincount(segment, minlength=has.size)[~has], minlength=SEGMENT + 1)


def train(texts: list[str | None], labels: list[int], weights: list[float]) -> Crf | None:
    """weights: how many documents each text stands for."""
    texts, toxic, weight = [t or "" for t in texts], np.array(labels, dtype=bool), np.array(weights, dtype=float)
    if not toxic.any() or toxic.all():
        return None
    own = near_copy_representatives(texts)
    texts, toxic, weight = [texts[i] for i in own], toxic[own], weight[own]
    model = Crf(np.sort(indicators(texts, toxic)))
    none = len(model.keys)
    held, empty = [], np.zeros(SEGMENT + 1, dtype=np.int64)
    for first, last in C.chunks(texts):
        words = C.Words(texts[first:last], PREFIXES)
        if words.doc.size:
            cols = model.columns(words)
            *found, without = segments(cols, ((cols < none).any(1) & toxic[words.doc + first]).astype(np.int8), words.doc, none)
            held.append(found)
            empty += without
    if held and sum(y.sum() for _, y, _ in held):
        lengths = np.flatnonzero(empty)
        x, y, mask = (np.concatenate(parts) for parts in zip(*held, strict=True))
        x = np.concatenate([x, np.full((lengths.size, *x.shape[1:]), none, dtype=np.int32)])
        y = np.concatenate([y, np.zeros((lengths.size, SEGMENT), dtype=np.int8)])
        mask = np.concatenate([mask, np.arange(SEGMENT) < lengths[:, None]])
        model.fit(x, y, mask, np.concatenate([np.ones(len(x) - lengths.size), empty[lengths]]))
    sums, tops = np.zeros(len(texts)), np.zeros(len(texts))
    for first, last in C.chunks(texts):
        for d, _, p in model.tag(C.Words(texts[first:last], PREFIXES)):
            sums[first + d], tops[first + d] = p.sum(), p.max()
    model.calibrate(sums, tops, toxic.astype(float), weight / weight.mean())
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _trainer(batches):
    rows = [batch.select(["text", "y", "weight"]).to_pydict() for batch in batches]
    model = train(*([x for r in rows for x in r[c]] for c in ("text", "y", "weight")))
    held = (model.keys, model.weight, model.bias, model.trans, model.calibration) if model else None
    C.trim()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["model"])


def _share(y: Column, most: dict[int, float], seed: int) -> Column:
    """Which rows of a label to take, by a hash of id and text."""
    chance = F.pmod(F.xxhash64("id", "text" if seed == 7 else F.lit(0), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    keep = F.lit(False)
    for label, share in most.items():
        keep = keep | ((y == label) & (chance < share))
    return keep


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 2000, max_chars: int = 16_000_000) -> Crf | None:
    """Learn from a bounded sample of labelled documents, none of them held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").cast("int").alias("y")).where(~held_out(F.col("id")))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = {y: min(1.0, max_train / n) for y, n in total.items()}
    chosen = known.where(_share(F.col("y"), ids, 5))  # about 2 * max_train rows of 12 bytes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # Ids may repeat and texts be long.
    sizes = rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    texts = {r["y"]: min(1.0, 1.25 * max_train / r["n"], max_chars / max(1, r["chars"] or 0)) for r in sizes}
    weight = F.lit(1.0)
    for y, share in texts.items():
        weight = F.when(F.col("y") == y, 1 / (ids[y] * share)).otherwise(weight)
    sample = rows.where(_share(F.col("y"), texts, 7)).select("id", "text", "y", weight.alias("weight"))
    found = sample.coalesce(1).sortWithinPartitions("id", "text").select("text", "y", "weight").mapInArrow(_trainer, "model binary").first()
    held = pickle.loads(bytes(found["model"])) if found else None
    if held is None:
        return None
    model = Crf(held[0])
    model.weight, model.bias, model.trans, model.calibration = held[1:]
    return model


def _places(text: str):
    """From places in the lower-cased text to those in the text; lower case can be longer."""
    if len(text.lower()) == len(text):
        return lambda k: k
    ends = np.cumsum([len(c.lower()) for c in text])
    return lambda k: int(np.searchsorted(ends, k, side="right"))


def _scorer(model: Crf | None):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in C.chunks(texts):
                score = np.full(b - a, model.score(np.zeros(0)) if model else 0.0)
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                if model and len(model.keys):
                    words = C.Words(texts[a:b], PREFIXES)
                    for d, at, p in model.tag(words):
                        score[d] = model.score(p)
                        place = _places(texts[a + d])
                        for i, q in zip(at[p >= 0.5], p[p >= 0.5], strict=True):
                            base = words.offset[d]
                            start = len(words.buffer[base : words.start[i]].decode("utf-8", "replace"))
                            end = start + len(words.buffer[words.start[i] : words.end[i]].decode("utf-8", "replace"))
                            spans[d].append({"start": place(start), "end": place(end - 1) + 1, "marginal": float(q)})
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))),
                ], names=["id", "score", "spans"])

    return run


def score(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted, spans) of every row."""
    rows = C.small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(model), f"id {rows.schema['id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,marginal:double>>")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, model: Crf | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs with a score under threshold, as they are; each is judged where it is read."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            for a, b in C.chunks(texts):
                score = np.full(b - a, model.score(np.zeros(0)) if model else 0.0)
                if model and len(model.keys):
                    for d, _, p in model.tag(C.Words(texts[a:b], PREFIXES)):
                        score[d] = model.score(p)
                yield batch.slice(a, b - a).filter(pa.array(score < threshold))
        C.trim()

    return C.small_batches(docs).mapInArrow(run, docs.schema)
