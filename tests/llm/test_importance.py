"""Resampling against a plain version, on tables with nulls, repeats, ties and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lantern.llm import importance

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, low, high):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return w, Counter(" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1))


def plain(docs, target, low, high, buckets, share, least):
    s, t = Counter(), Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g, n in grams(x, low, high)[1].items():
                side[zlib.crc32(g.encode()) % buckets] += n
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        w, g = grams(text, low, high)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] * n for x, n in g.items())
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, sum(g.values()), weight, score, None, len(w)])
    may = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: share * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(n):
    words = ["the", "Of", "É", "zoë", "long" * 30, "a1", "x-y", "tail"] + [f"w{k}" for k in range(40)]
    return [(i, " ".join(words[(i * i + k * (1 + i % 5)) % len(words)] for k in range(i % 37))) for i in range(n)] + [(None, "the of the of"), (None, None), (7, None), (8, ""), (3, "the of"), (3, "the of"), (900, "x\ty\nZ " * 9000)]


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("feature", "bucket", "gain", "rank", "n", "k1", "_at", "rest")})


def test_equals_the_plain_version(spark, monkeypatch):
    docs, target = rows(120), ["the w1 w2 w3", None, "", "zoë É w5 w5"]
    sought = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    for low, high, held, hot in ((1, 1, 400_000, 1 / 20_000), (1, 2, 7, 1 / 40), (2, 3, 50, 1.1)):
        monkeypatch.setattr(importance, "HELD", held)
        monkeypatch.setattr(importance, "HOT", hot)
        got = importance.resample(table(spark, docs).repartition(5), sought, 30, 5, low=low, high=high, buckets=50)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, low, high, 50, 30, 5)


def test_very_long_texts_are_split_between_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "OUT", 10)
    monkeypatch.setattr(importance, "HOT", 0.2)
    docs = [(1, " ".join(f"w{k}" for k in range(205))), (2, "w1 w2 w3 " * 10)]
    run = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w7",)], "text string"), 50, 20, buckets=10)
    assert sorted(map(tuple, run.collect()), key=str) == plain(docs, ["w7"], 1, 1, 10, 50, 20)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert [r["weight"] for r in importance.resample(some, none).collect()] == [plain([(1, "a b")], [], 1, 1, 10_000, 10, 20)[0][2]]
