"""Repeated strings against a plain count of windows, with copies, periodic and long texts, nulls and clashing columns."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import repeats


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), dtype=np.uint8), [0]]).astype(int)))
        out.append((len(t), [(int(a), int(b)) for a, b in edges.reshape(-1, 2)], bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def texts(length, n=60, seed=5):
    rng = random.Random(seed)
    line = lambda k: "".join(rng.choice("abé 中d") for _ in range(k))
    passages = [line(rng.randrange(length // 3, 2 * length)) for _ in range(6)]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice([line(rng.randrange(1, length)), rng.choice(passages)]) for _ in range(rng.randrange(1, 7))))
    out += out[:5] * 2 + [passages[0][1:], passages[0] + "x", None, "", "a", "z" * (3 * length), "ab" * (2 * length), out[7][3:] + "tail", line(40 * length) + passages[1]]
    return out


@pytest.mark.parametrize("length, block, anchor, section, together, held", [(200, 1 << 18, 8192, 1 << 22, 1 << 18, 300_000), (30, 500, 3, 100, 300, 50), (20, 1, 1, 1 << 22, 1, 1), (7, 400, 6, 64, 64, 9)])
def test_equals_the_plain_version(spark, monkeypatch, length, block, anchor, section, together, held):
    for name, value in (("BLOCK", block), ("ANCHOR", anchor), ("HELD", held)):
        monkeypatch.setattr(repeats, name, value)
    own = texts(length)
    rows = [(k if k % 11 else None, t) for k, t in enumerate(own)] + [(5, own[5])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "k1", "anchor", "place", "spans", "runs", "n")}).repartition(3)
    got = repeats.remove_repeats(df, length)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    want = [(i, *r) for (i, _), r in zip(rows, plain([t for _, t in rows], length), strict=True)]
    found = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_segments_name_equal_windows_alike(monkeypatch):
    """Sections and batches of any size find every window once; equal windows have equal anchors."""
    import pyarrow as pa

    length, own = 20, [t for t in texts(20) if t]
    for section, together in ((1 << 22, 1 << 18), (64, 100), (1, 1)):
        monkeypatch.setattr(repeats, "SECTION", section)
        monkeypatch.setattr(repeats, "TOGETHER", together)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64())] * 2 + [pa.array([t.encode() for t in own])], names=["k1", "k2", "text"])
        anchors, windows = {}, Counter()
        for found in repeats._each(batch, length):
            for anchor, _, row, _, place in zip(*(c.tolist() for c in found), strict=True):
                for i in range(place >> 20, (place >> 20) + (place & ((1 << 20) - 1))):
                    windows[row, i] += 1
                    assert anchors.setdefault(own[row].encode()[i : i + length], anchor) == anchor
        assert windows == Counter((k, i) for k, t in enumerate(own) for i in range(len(t.encode()) - length + 1))


def test_common_prefixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:420] = data[100:220]
    places, prefix = repeats.expansion(np.concatenate([data, np.zeros(108, np.uint8)]), 100)
    text = bytes(data) + bytes(108)
    ring = text + text
    for at in range(1, places.size):
        a, b = (ring[p : p + 100] for p in (places[at - 1] % len(text), places[at] % len(text)))
        assert a <= b
        assert prefix[at] == next((k for k in range(100) if a[k] != b[k]), 100)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
