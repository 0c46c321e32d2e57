"""The updatable index against bm25 over the live texts; folding; batch retrieval against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from lantern.functions.text import FOLD, folded, terms, terms_of
from lantern.operators import index, lexical

WORDS = ["señora", "Straße", "naïve", "light", "house", "public", "license", "Ångström", "x1", "Москва", "the", "ὁδός"]


def texts(n, seed):
    rng = random.Random(seed)
    return {i: rng.choice([" ", " - "]).join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60))) for i in range(n)}


def fresh(spark, live, query, scope=None):
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in live.items()], "doc_id long, text string, scope string")
    found = lexical.bm25(docs, query, scope=F.col("scope") == scope if scope else None)
    return {r["doc_id"]: round(r["bm25"], 9) for r in found.select("doc_id", "bm25").collect()}


def found(df):
    return {r["id"]: round(r["bm25"], 9) for r in df.collect()}


@pytest.mark.parametrize("block, bucket", [(128, 4_000_000), (3, 200)])
def test_updates_deletes_and_merging_equal_a_fresh_index(spark, tmp_path, monkeypatch, block, bucket):
    monkeypatch.setattr(index, "BLOCK", block)
    monkeypatch.setattr(index, "BUCKET", bucket)
    live, path = texts(80, 1), f"{tmp_path}/i"
    table = lambda rows: spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in rows.items()], "doc_id long, text string, scope string").repartition(3)
    put = lambda rows, gone=None: index.update(table(rows), path, "doc_id", scope=F.col("scope"), deleted=gone)
    put(live)
    again = {i: t for i, t in texts(100, 2).items() if i % 4 == 0}
    put(again, spark.createDataFrame([(5,), (9,), (1000,)], "id long"))
    live = {i: t for i, t in live.items() if i not in (5, 9)} | again
    put({5: "back again in the light house", 8: None}, spark.createDataFrame([(12,)], "id long"))
    live = {i: t for i, t in live.items() if i != 12} | {5: "back again in the light house", 8: ""}
    index.merge(spark, path, f"{tmp_path}/m")
    for where in (path, f"{tmp_path}/m"):
        for query, scope in ((["senora", "light", "X1"], "s1"), (["public license", "light", "moskva", "москва"], "s2"), (["light", "light"], None)):
            want = fresh(spark, live, query)
            assert found(index.search(spark, where, query)) == want
            own = fresh(spark, live, query, scope) if scope else want
            assert found(index.search(spark, where, query, 5, scope)) == dict(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:5])
            rounded = sorted(((-round(s, 2), i) for i, s in own.items()))[:5]
            assert [(-r["bm25"], r["id"]) for r in index.search(spark, where, query, 5, scope, 2).collect()] == rounded
    assert index.search(spark, f"{tmp_path}/none", ["light"]).count() == 0 and index.search(spark, path, ["..."]).count() == 0


def test_top_k_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    rows = [(i, "light " * (30 if i < 12 else 1) + "filler words " * (i % 7 + 3)) for i in range(400)] + [(i, "filler words") for i in range(400, 900)]
    index.update(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/i", "doc_id")
    read = []
    real = index._best
    monkeypatch.setattr(index, "_best", lambda df, k, d: (read.append(df), real(df, k, d))[1])
    best = index.search(spark, f"{tmp_path}/i", ["light"], 5)
    assert found(best) == dict(sorted(fresh(spark, dict(rows), ["light"]).items(), key=lambda x: (-x[1], x[0]))[:5])
    assert read[0].count() < 60  # of 400 documents with the term


def test_terms_fold_and_split_alike_everywhere(spark):
    odd = ["Señora — ¿qué?", "ÀÉÎõü ǖ ộ ΐ й ё", "étude côté", "don't x_y a1٣", "日本語テキスト", "", "İstanbul ﬁn ß", "a b"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(folded(F.col("t")).alias("f"), terms(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [terms_of(t) for t in odd]
    assert got[0]["w"] == ["senora", "que"] and got[2]["w"] == ["etude", "cote"] and got[3]["w"] == ["don", "t", "x", "y", "a1٣"]
    assert FOLD["é"] == "e" and FOLD["й"] == "и" and "ø" not in FOLD
