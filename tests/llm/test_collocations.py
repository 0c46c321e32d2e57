"""Collocations against a plain count, with small containers and shards, long pieces, nulls and clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, most, top, cover):
    counts = {}
    for text, lang in docs:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                f.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        often = [p for p, a in f.items() if len(p) > 1 and a >= least]
        longest = Counter()
        for p in often:
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longest[p[i : i + n]] = max(longest[p[i : i + n]], f[p])
        rows = []
        for p in often:
            if p in longest and 100 * longest[p] >= cover * f[p]:
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, f[p], " ".join(p), f[p[:k]], f[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, n, phrase, a, l, r, total, score) for n, (score, a, phrase, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def texts(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "É", "x\x1fy", "\xa0z", "a-b", "city", "in", "w w", "(q)"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 9)):
            w = [rng.choice(words) for _ in range(rng.randrange(0, 12))]
            if rng.random() < 0.4:
                w[1:1] = ["new", "York", "city"]
            parts.append(rng.choice([" ", "\t", "  "]).join(w))
        out.append((rng.choice([". ", ",", "\n", "\r\n", "!?", ";", " : "]).join(parts), rng.choice(["en", "fr", None])))
    return out + [(None, "en"), ("", None), ("the " * 700, "en"), ("of the, " * 50, "fr"), ("solo", "de")]


@pytest.mark.parametrize("bits, shard, held, least, most, top", [(512, 1 << 22, 400_000, 5, 4, 2000), (64, 60, 10, 3, 4, 40), (64, 500, 50, 4, 3, 15), (128, 1, 1, 30, 2, 2000)])
def test_equals_the_plain_version(spark, monkeypatch, bits, shard, held, least, most, top):
    for name, value in (("BITS", bits), ("SHARD", shard), ("HELD", held)):
        monkeypatch.setattr(collocations, name, value)
    docs = texts(80)
    df = spark.createDataFrame(docs, "text string, lang string").withColumns({c: F.lit(1) for c in ("id", "p", "f", "shard", "words", "n", "rank")}).repartition(3)
    got = collocations.collocations(df, least, most, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs, least, most, top, 80)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


@pytest.mark.parametrize("bits, slab", [(64, 1), (64, 7), (128, 3), (512, 256)])
def test_containers_count_each_start_once(monkeypatch, bits, slab):
    monkeypatch.setattr(collocations, "SLAB", slab)
    rng = np.random.default_rng(1)
    for most, gap in ((2, 0.05), (3, 0.01), (4, 0.001), (4, 0.3)):
        seq = np.where(rng.random(3000) < gap, 0, rng.integers(1, 5, 3000)).astype(np.int32)
        pairs = np.sort(np.array([a << 32 | b for a in range(1, 5) for b in range(1, 5) if a + b != 5]))
        for frequent in (None, pairs, pairs[:0]):
            counts = Counter()
            for columns, n in collocations._all_of(seq, most, bits, frequent):
                for *p, k in zip(*(c.tolist() for c in columns), n.tolist(), strict=True):
                    counts[tuple(p)] += k
            s = seq.tolist()
            good = lambda t: 0 not in t and (frequent is None or all(a + b != 5 and frequent.size for a, b in zip(t, t[1:], strict=False)))  # noqa: B023, E731
            assert counts == Counter(t for k in range(2, most + 1) for t in zip(*(s[i:] for i in range(k)), strict=False) if good(t))


def test_a_task_of_the_usual_size_makes_one_shard_of_a_language(monkeypatch):
    monkeypatch.setattr(collocations.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = collocations.pa.RecordBatch.from_pydict({"lang": ["en", "fr", "en"], "text": [b"a b " * 1_250_000, b"c " * 2_500_000, b"b c " * 1_250_000]})
    assert [s.column("total").to_pylist() for s in collocations._sharder(collocations.SHARD)([batch])] == [[5_000_000], [2_500_000]]
