"""Names by trigrams against a plain search."""

import random

from lantern.operators import graph, names


def test_containing(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = {i: word(rng.randrange(0, 12)) for i in range(150)} | {900: None, 901: "", 902: "日本語の名前"}
    sought = {i: word(rng.randrange(0, 6)) for i in range(60)} | {70: None, 71: "", 72: "本語", 73: "a", 74: "zz"}
    got = names.containing(spark.createDataFrame(list(texts.items()), "text_id long, text string"), spark.createDataFrame(list(sought.items()), "sought_id long, text string"))
    want = {(t, s) for t, x in texts.items() for s, y in sought.items() if x is not None and y and y in x}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert names.containing(spark.createDataFrame([(1, "abc")], "text_id long, text string"), spark.createDataFrame([(1, "")], "sought_id long, text string")).count() == 0


def test_endpoints_as_one_by_one(spark):
    rng = random.Random(2)
    parts = ["iron", "man", "suit", "stark", "red", "x", "vault"]
    nodes = spark.createDataFrame([(f"n{i:03}", " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))).title(), rng.choice(["Character", "Object", "Event", "Odd"])) for i in range(60)], "id string, name string, label string")
    wanted = {"Iron Man": ["iron", "man"], "the red suit of stark": ["red", "suit", "stark"], "nobody": ["nobody"], "old vault door": ["old", "vault", "door"]}
    got = names.endpoints(nodes, spark.createDataFrame([(n,) for n in wanted], "name string"), spark.createDataFrame([(n, t) for n, ts in wanted.items() for t in ts], "name string, token string"))
    found = {}
    for r in got.orderBy("name", "rank").collect():
        found.setdefault(r["name"], []).append(r["id"])
    for name, tokens in wanted.items():
        one = [r["id"] for r in graph.endpoint_candidates(nodes, name, tokens).collect()]
        assert found.get(name, []) == one
