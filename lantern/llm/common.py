"""Shared pieces: table access, checkpoints, union-find and vectorised word hashing.

Words are the maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing.
Every byte of a non-ASCII UTF-8 character is a word byte, so words are found on bytes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators.graph import components
from lantern.plans.lineage import cut

__all__ = ["components", "cut"]

#: Bytes of a text that are hashed at once; bounds the memory of a task, not the text.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(row_id, text) -> list:
    """k1 and k2, 128 bits that name a row by its id and text; rows with equal ids and texts have equal names."""
    return [F.xxhash64(row_id, text).alias("k1"), F.xxhash64(F.lit("row"), text, row_id).alias("k2")]


def trim() -> None:
    """Give memory that a task has freed back to the machine; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        release(0)


#: Bytes of an Arrow batch, unless the session sets another size; of whole texts, Spark's own size is much for a worker.
BATCH_BYTES, SPARKS_OWN = "8388608b", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands texts to the workers in batches of BATCH_BYTES."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, SPARKS_OWN) == SPARKS_OWN:
        conf.set(name, BATCH_BYTES)
    return df


def star_edges(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For links (i, j) among n rows, each row's root: the smallest linked index."""
    root = np.arange(n)
    while i.size:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    return root


# -- hashing -------------------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BYTE = np.array([x > 0x7F or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A for x in range(256)])
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_held: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, n of each at least."""
    if "p" not in _held or _held["p"][0].size < n:
        size = max(n, CHUNK_BYTES * 2)
        one = np.ones(1, dtype=np.uint64)
        _held["p"] = tuple(np.cumprod(np.concatenate([one, np.full(size, x)])) for x in (_BASE, _BASE_INV))
    return _held["p"]


class Words:
    """Words of a list of texts: doc (index of the text), start and end (bytes of `buffer`), hash."""

    def __init__(self, texts: list[str | None], prefixes: tuple[int, ...] = ()):
        low = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        self.buffer = b"\x00".join(low) + b"\x00"
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        inside = np.zeros(data.size + 1, dtype=bool)
        inside[1:] = _WORD_BYTE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low])])
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        power, inverse = powers(data.size)
        total = np.zeros(data.size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: data.size], out=total[1:])
        inverse = inverse[self.start]
        self.hash = mix((total[self.end] - total[self.start]) * inverse)
        self.prefix = {k: np.where(self.end - self.start > k, mix((total[np.minimum(self.start + k, self.end)] - total[self.start]) * inverse + np.uint64(k)), np.uint64(0)) for k in prefixes}
        self.n = len(texts)


def chunks(texts: list, size: int = CHUNK_BYTES):
    """(first, last) index ranges of texts of about size characters each; at least one text in each."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def shingles(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word k-gram hashes of each text: (doc index, hash), sorted by both.

    A text of 1 to k-1 words has one shingle, of all its words; a text without words has none.
    """
    w = Words(texts)
    count = np.bincount(w.doc, minlength=w.n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    total = w.hash.size
    h = np.zeros(max(0, total - k + 1), dtype=np.uint64)
    for j in range(k):
        h += w.hash[j : j + h.size] * _STEP[j]
    good = w.doc[: h.size] == w.doc[k - 1 :] if h.size else np.zeros(0, bool)
    docs, out = w.doc[: h.size][good], mix(h[good])
    few = np.flatnonzero((count > 0) & (count < k))
    if few.size:
        s = np.zeros(few.size, dtype=np.uint64)
        for j in range(k - 1):
            has = count[few] > j
            s[has] += w.hash[first[few[has]] + j] * _STEP[j]
        docs, out = np.concatenate([docs, few]), np.concatenate([out, mix(s + np.uint64(1))])
    order = np.lexsort((out, docs))
    docs, out = docs[order], out[order]
    fresh = np.ones(docs.size, dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (out[1:] != out[:-1])
    return docs[fresh], out[fresh]


def minhash(docs: np.ndarray, hashes: np.ndarray, n: int, size: int, seed: int = 7) -> np.ndarray:
    """Signatures (n, size) of 32-bit MinHash values; rows of docs without shingles are all ones."""
    out = np.full((n, size), 0xFFFFFFFF, dtype=np.uint32)
    if not docs.size:
        return out
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    who = docs[at]
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, size, dtype=np.uint64)
    for i in range(size):
        out[who, i] = np.minimum.reduceat(((hashes * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_keys(signature: np.ndarray, rows: int, seed: int = 11) -> np.ndarray:
    """One 64-bit key (as int64) for each run of `rows` MinHash values."""
    n, size = signature.shape
    rng = np.random.default_rng(seed)
    m = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = signature.reshape(n, size // rows, rows).astype(np.uint64)
    return mix((parts * m).sum(2, dtype=np.uint64) + np.arange(size // rows, dtype=np.uint64)).view(np.int64)
