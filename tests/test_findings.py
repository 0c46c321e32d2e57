"""Faults that larger tables and odd inputs showed, each by a small case."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lantern import catalog_search as Q
from lantern.operators import graph, index, knowledge, lexical, names, retrieval, vector


def same(spark, folder, name, **tables):
    """The query's rows over the given tables, as its SQL has them."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(folder))
    done = db.execute(Q.ORACLES[name])
    names = [d[0] for d in done.description]
    ours, theirs = sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(done.fetchall())
    assert ours == theirs
    return ours


def test_chunks_of_cues_out_of_order(spark, tmp_path):
    rows = [(2, 0, "Short."), (2, 1, "Later than the next."), (2, 2, "x" * 30 + "."), (3, 0, "y" * 190), (3, 1, "A line break follows.\n"), (3, 2, "So it goes on."), (4, 0, " wide spaces　")]
    got = same(spark, tmp_path, "chunk_records", conversations=spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string"))
    assert {(r[3], r[4], r[5], r[6]) for r in got if r[1] == "conv:2"} == {(0, 0, 0, 1125), (1, 2, 8000, 10125)} and len([r for r in got if r[1] == "conv:3"]) == 2


def test_an_update_of_the_index_reads_texts_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"light house {i % 7} light" if i % 5 else None, f"s{i % 3}" if i % 4 else None) for i in range(60)], "doc_id long, text string, s string")
    put = lambda d: index.update(d.mapInArrow(counted, "doc_id long, text string, s string"), f"{tmp_path}/i", "doc_id", scope=F.col("s"))
    put(docs)
    assert seen.value == 60
    put(docs.where("doc_id < 20").withColumn("text", F.concat("text", F.lit(" house"))))
    want = sorted(map(tuple, index.search(spark, f"{tmp_path}/i", ["light house", "house"], scope="s1", digits=6).collect()))
    for most, into in ((4_000_000, "a"), (0, "b")):  # replaced documents sent to the tasks, and joined
        monkeypatch.setattr(index, "REPLACED", most)
        index.merge(spark, f"{tmp_path}/i", f"{tmp_path}/{into}")
        assert sorted(map(tuple, index.search(spark, f"{tmp_path}/{into}", ["light house", "house"], scope="s1", digits=6).collect())) == want and len(want) > 9


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrases_of_a_boolean_question_fold_the_text_once(spark):
    docs = spark.createDataFrame([(1, "Light and house"), (2, "light house"), (3, None), (4, "and house, LIGHT")], "doc_id long, text string")
    one, three = lexical.boolean_and(docs, "light"), lexical.boolean_and(docs, 'and "light" house')
    assert plan(one).count("regexp_replace") == plan(three).count("regexp_replace")
    assert three.columns == ["doc_id", "text"] and {r["doc_id"] for r in three.collect()} == {1, 4}


def test_term_statistics_shuffle_terms_alone(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (None, ""), (4, "á")], "doc_id long, text string")
    assert plan(lexical.term_statistics(docs, "doc_id")).count("Exchange hashpartitioning") == 1
    assert same(spark, tmp_path, "doc_stats_postings", documents=docs) == [("a", 2, 3), ("b", 2, 2), ("c", 1, 1)]
    assert same(spark, tmp_path / "twice", "doc_stats_postings", documents=docs.union(docs.limit(2))) == [("a", 2, 5), ("b", 2, 4), ("c", 1, 2)]


def test_similarities_are_held_in_slices(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0 + i % 3]) for i in range(150)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, vector.batch_top_k(v, v, 4).collect()))
    monkeypatch.setattr(vector, "HELD", 100)
    got = sorted(map(tuple, vector.batch_top_k(v, v, 4).collect()))
    assert [(a, r) for a, _, _, r in got] == [(a, r) for a, _, _, r in want] and len(got) == 600
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 1e-12


def test_neighbours_are_asked_for_by_every_fiftieth_vector(spark, tmp_path):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0 + i % 3], 1) for i in range(120)], "vec_id long, embedding array<double>, label int")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["query_id"] for r in Q.QUERIES["ann_batch_topk"](spark, str(tmp_path)).collect()} == {0, 50, 100}


def test_what_is_known_of_names_goes_to_the_mentions(spark, monkeypatch):
    sent, real = [], knowledge.small
    monkeypatch.setattr(knowledge, "small", lambda df, *a: (sent.append(df.columns), real(df, *a))[1])
    rows = [(i, ["Ann", "Bob", "Bobby"][i % 3], "Character", ["bobby"] if i == 1 else []) for i in range(30)]
    outcomes, entities = knowledge.register_in_order(spark.createDataFrame(rows, "seq long, name string, kind string, aliases array<string>"))
    assert {r["seq"]: r["entity_id"] for r in outcomes.collect()} == {i: ["character:ann", "character:bob", "character:bob"][i % 3] for i in range(30)}
    assert sent == [["_k", "_key", "at"], ["id", "made"]] and entities.count() == 2


def test_phrases_are_followed_in_texts():
    rng = random.Random(4)
    phrases = sorted({tuple(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(40)})
    texts = [rng.choices("abcd", k=rng.randrange(0, 9)) for _ in range(200)] + [["ab"]]
    got = zip(*(x.tolist() for x in lexical._counts(*lexical.sought(list(map(list, phrases))), lexical.pa.array([" ".join(t) for t in texts]))), strict=True)
    want = {(k, j): n for k, t in enumerate(texts) for j, p in enumerate(phrases) if (n := sum(tuple(t[i : i + len(p)]) == p for i in range(len(t))))}
    assert {(k, j): n for k, j, n in got} == want


def test_ngrams_of_rows_of_one_id_count_once(spark, tmp_path):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    docs = spark.createDataFrame([(1, words(0, 9)), (1, words(2, 9)), (None, words(3, 12)), (2, words(0, 5)), (3, None), (4, f"{words(0, 3)}. É {words(3, 20)}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, words(0, 8)), (7, words(1, 8)), (8, words(0, 3).upper()), (None, f"é {words(3, 9)}"), (9, None)], "item_id long, text string")
    by_ngrams = lexical.ngram_overlap(docs, items, 6, most=0)
    assert sorted(map(str, map(tuple, by_ngrams.collect()))) == sorted(map(str, map(tuple, lexical.ngram_overlap(docs, items, 6).collect())))
    known = docs.where("doc_id is not null"), items.where("item_id is not null")
    sliced = lexical.phrase_counts(docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("dl"), F.split(F.lower("text"), r"\W+").alias("w")).coalesce(1), [["w3", "w4"], ["w0"]], most=20)
    assert sorted((str(r["id"]), r["p"], r["tf"]) for r in sliced.collect()) == [("1", [0], [1]), ("1", [0, 1], [1, 1]), ("2", [0, 1], [1, 1]), ("4", [0, 1], [1, 1]), ("None", [0], [1])]
    assert (7, 1, 3) in same(spark, tmp_path, "ngram_overlap", documents=known[0], benchmark=known[1])
    assert plan(lexical.ngram_overlap(docs, items, 6)).count("array_distinct") == 0 < plan(by_ngrams).count("array_distinct")


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_many_questions_are_ranked_where_the_documents_are(spark, monkeypatch, held):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(["Lamp", "house", "don't", "t", "tree", "sea"], [1, 5, 2, 1, 3, 9], k=rng.randrange(0, 12)))
    docs = spark.createDataFrame([(i, text() if i % 9 else None) for i in range(120)] + [(200 + i, "sea lamp tree") for i in range(9)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(c, w) for c in ("x", "y", None) for w in ("lamp", "don't", "don-t", "tree sea", "tree", "?")[ord(c or "w") % 3 :]] + [("x", "tree"), ("z", "nowhere")], "case_id string, phrase string")
    monkeypatch.setattr(retrieval, "HELD", held)
    got = retrieval.search_many(docs, asked, 6)
    assert plan(got).count("HashAggregate") == 0  # nothing is summed by (case, document) after a shuffle
    rows = lambda df: sorted(((r["case_id"] or ""), r["rank"], r["doc_id"], round(r["bm25"], 6)) for r in df.collect())
    monkeypatch.setattr(retrieval, "ASKED", 0)
    assert rows(got) == rows(retrieval.search_many(docs, asked, 6)) and got.count() == 18
    assert retrieval.search_many(docs, asked.where("false"), 6).count() == 0
    monkeypatch.setattr(retrieval, "ASKED", 100)
    assert retrieval.search_many(docs, asked.where("phrase = 'nowhere'"), 6).count() == retrieval.search_many(docs, asked.where("false"), 6).count() == 0
    twice = docs.union(docs.limit(30))
    assert retrieval.search_many(twice, asked, 6).select("case_id", "doc_id").distinct().count() == 18


def test_nodes_that_differ_in_their_ids_alone_are_looked_at_thrice_at_most(spark, tmp_path, monkeypatch):
    rows = [(i, ["Iron suit", "iron", "iron suit of red", "vault"][i % 4], ["Object", "Event"][i % 3 == 0], f"B{i % 2}") for i in range(80)]
    nodes = spark.createDataFrame([r[:3] for r in rows], "id long, name string, label string")
    seen, real = [], names.containing
    wanted = {"iron suit": ["iron", "suit"], "the red vault door": ["red", "vault"], "old suit": ["old", "suit"], "x": ["x"]}
    tables = spark.createDataFrame([(n,) for n in wanted], "name string"), spark.createDataFrame([(n, t) for n, ts in wanted.items() for t in ts], "name string, token string")
    got = {(r["name"], r["rank"]): r["id"] for r in names.endpoints(nodes, *tables).collect()}
    assert got == {(n, k): r["id"] for n, ts in wanted.items() for k, r in enumerate(graph.endpoint_candidates(nodes, n, ts).collect(), 1)}
    assert names.endpoints(nodes.limit(0), *tables).count() == 0
    monkeypatch.setattr(names, "containing", lambda texts, sought: (seen.append(max(df.count() for df in (texts, sought))), real(texts, sought))[1])
    assert names.endpoints(nodes, *tables).count() == len(got) and max(seen) <= 3 * 4 * 2  # four names, two labels
    same(spark, tmp_path, "endpoints_batch", part=spark.createDataFrame([(i, n, t.upper(), b) for i, n, t, b in rows], "p_partkey long, p_name string, p_type string, p_brand string"))
    same(spark, tmp_path / "twice", "endpoints_batch", part=spark.createDataFrame([(1, "iron", "BIG", "B"), (2, "iron lost", "BIG", "B"), (2, "lost gear", "BIG", "B")], "p_partkey long, p_name string, p_type string, p_brand string"))
