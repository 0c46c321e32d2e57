"""Edge cases of the training-data operators and of the pipeline's stages, by value."""


import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lantern.llm import decontaminate, html_text, jaccard_join, licenses, line_dedup, nn_descent, pii_surrogates, secrets, sentencepiece_lattice, toxicity
from lantern.llm.queries import TOKENIZER

from .test_llm import ODD, _own, odd, toxic_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_html_unclosed_elements(spark):
    rows = [(1, "http://h/1", "<p>a<svg>b</p><p>rest of the page</p>"), (2, "http://h/2", "<article><p>x <svg><text>no</text></svg>y</p><math><mi>z</mi></math></article>"), (3, None, "<p>plain"), (4, "http://h/4", "<article>a<script>no"), (None, "http://h/5", "&lt;b&gt; &amp; c")]
    got = {r["page_id"]: r["text"] for r in html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "ab\nrest of the page", 2: "x y\nz", 3: "plain", 4: "a", None: "<b> & c"}


def test_html_teasers_and_readers():
    text = lambda html: html_text.main_lines(html_text.lines_of(html), set())
    story = "<h1>Headline here</h1><p>First long paragraph of the story.</p><p>Second paragraph of the story.</p>"
    lines = ["Headline here", "First long paragraph of the story.", "Second paragraph of the story."]
    assert text(f"<main>{story}<article><h3>Other story</h3><p>Teaser text.</p></article></main>") == lines
    assert text(f"<div>{story}</div><article>Card one</article><article>Card two</article>") == lines
    assert text(f"<article>{story}</article><article>Teaser.</article>") == lines
    assert text(f"<article>{story}<div class='feedback'>Reader A</div><ul id='responses'><li>Reader B</li></ul></article><div>open</div>") == lines
    assert text("<article>One of two posts.</article><article>Two of two posts.</article>") == ["One of two posts.", "Two of two posts."]


def test_html_unended_elements_are_linear():
    import time

    began = time.process_time()
    for tag in ("object", "svg", "noscript"):
        lines = html_text.lines_of("<article>" + f"<{tag}> a " * 40_000 + "</article>")
        assert lines == [(" ".join("a" * 40_000), "article 1")]
    assert html_text.lines_of("<p>x</p>" + "<! " * 100_000)
    assert time.process_time() - began < 20


def test_html_by_brute_force(spark):
    """Pages without an article: lines that the nearest path of the host shares go."""
    rng = np.random.default_rng(5)
    frames = [f"Frame line {x} {_own(3000 + x, 3)}" for x in range(12)]
    pages = {}
    for i in range(90):
        shown = sorted(rng.choice(12, rng.integers(3, 9), replace=False))
        body = [frames[x] for x in shown[:3]] + [_own(7 * i + k, 8) for k in range(7)] + [frames[x] for x in shown[3:]]
        pages[i] = (f"http://h{i % 3}.org/{'/'.join(rng.choice(list('abc'), rng.integers(1, 4)))}/{i}.html", body)
    rows = [(i, u, "<html><body>" + "".join(f"<div>{x}</div>" for x in b) + "</body></html>") for i, (u, b) in pages.items()]
    got = {r["page_id"]: r["text"] for r in html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i, (url, body) in pages.items():
        host = url.split("/")[2]
        path = {u.split(host)[1]: b for u, b in pages.values() if u.split("/")[2] == host}
        order = sorted(path)
        at = order.index(url.split(host)[1])
        beside = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        nearest = max(beside, key=lambda p: (sum(1 for _ in iter_prefix(p, order[at])), -beside.index(p)))
        assert got[i] == "\n".join(x for x in body if x not in path[nearest])


def iter_prefix(a, b):
    for x, y in zip(a, b, strict=False):
        if x != y:
            return
        yield x


def test_licenses_with_own_templates(spark):
    rows = spark.createDataFrame([(1, "Foo bar is granted to every reader!"), (2, "foo bar is granted"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(rows, templates={"foo": "foo bar is granted to every reader"}).collect()}
    assert got == {1: "foo", 2: "", 3: "", 4: ""}


def test_licenses_need_their_whole_wording():
    automata = {k: licenses.Automaton(t) for k, t in licenses.TEMPLATES.items()}
    labels = lambda t: set(licenses.scan(t, automata)[5].split(","))
    text = licenses.TEMPLATES["mit-text"].replace("[[{{thing:1-2}}]] ", "").replace("[[including the next paragraph]] ", "").replace("{{holder:0-6}} ", "")
    assert {"mit", "mit-clause"} <= labels(text) and "mit" not in labels(text.replace("tort", "sport")) and "mit-clause" in labels(text.replace("tort", "sport"))
    two = (licenses.BSD_START + licenses.BSD_END).replace("[[1]] ", "").replace("[[2]] ", "").replace("{{holder:1-8}}", "the copyright holders and contributors")
    assert "bsd-2-clause" in labels(two) and "bsd-3-clause" not in labels(two)


def test_nn_descent_of_extreme_norms(spark):
    rows = [(1, [1e-200, 0.0], 0), (2, [2e-200, 0.0], 0), (3, [1e200, 1e200], 1), (4, [2e200, 2e200], 1), (5, [], 0), (6, None, None), (7, [float("inf"), 1.0], 0), (7, [3.0, 0.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (7, 2, 1)]


def test_nn_descent_ends_exactly(spark, monkeypatch):
    """Where the descent can't reach the recall, all nodes of a label are compared, by blocks."""
    monkeypatch.setattr(nn_descent, "LAST", 1)
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 8))
    rows = [(i, (base[i % 12] + 0.12 * rng.standard_normal(8)).tolist(), i % 2) for i in range(150)]
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), k=1, tables=1, rounds=0, target=1.01).collect()}
    unit = {i: (np.array(v) / np.linalg.norm(v), y) for i, v, y in rows}
    for i, (v, y) in unit.items():
        assert got[i]["n_links"] == sum(j != i and z == y and u @ v >= 0.93 for j, (u, z) in unit.items()) and got[i]["recall"] == 1.0


def test_secrets_on_findings_held_out(spark):
    """Every other finding of the made-up ones is held out; and kinds of labels."""
    rows = secrets.labelled_findings(spark, 1600).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(2)))
    precision, recall = secrets.measure(rows.where("h = 0").drop("h"), rows.where("h = 1").drop("h"))
    assert precision > 0.9 and recall > 0.9
    text = spark.createDataFrame([(1, "token = a1b2c3d4e5f6a7b8c9"), (1, "token = a1b2c3d4e5f6a7b8c9"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([("key = 0a1b2c3d4e5f60718", None), ("see 123456789012345", 7.0)], "text string, label double")
    for held, want in ((labels, 0.0), (labels.withColumn("label", F.lit(0)), 0.0), (labels.withColumn("label", F.lit(1)), 1.0), (labels.where("false"), 0.0)):
        assert [r["score"] for r in secrets.secret_scan(text, held).collect()] == [want, want]
    assert secrets.secret_scan(text.where("false"), labels).count() == 0


def test_toxic_spans_are_places_of_the_text(spark):
    rows, labels = toxic_rows(160)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    word = next(t for i, t in rows if dict(labels).get(i))
    shown = toxicity.score(spark.createDataFrame([(1, word), (2, "İİ " + word)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    one, two = ([(s["start"], s["end"]) for s in r["spans"]] for r in shown)
    assert one and two == [(a + 3, b + 3) for a, b in one]


def test_training_is_bounded(spark):
    """Within its bounds the sample is whole; beyond them it is smaller, and ids that repeat don't count twice over."""
    rows, labels = toxic_rows(160)
    docs, known = spark.createDataFrame(rows * 3, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.fit(docs, known, max_chars=1) is None or len(toxicity.fit(docs, known, max_chars=1).keys) == 0
    assert len(toxicity.fit(docs, known).keys) > 0


def test_one_row_of_each_group_stays(spark):
    text, other = _own(1, 30), _own(2, 30)
    rows = [(1, text), (1, text + " end"), (1, text), (2, text), (3, other), (None, other), (4, None), (5, ""), (5, ""), (6, other + " x")]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert sorted(i for i, _ in got if i == 1 or i == 2) == [1]
    assert [r for r in got if r[0] != 1] == sorted([(3, other), (None, other), (4, None), (5, ""), (5, "")], key=str)


def test_odd_rows_by_value(spark):
    """Nulls, empty texts, repeated rows and clashing columns give the stated results."""
    d = odd(spark)
    text = {i: t for i, t, _ in ODD}
    bench = spark.createDataFrame([(7, "one"), (8, None), (9, "")], "item_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in decontaminate.contaminated(d, bench).collect()) == [0, 3, 3]
    assert sorted(str(r["doc_id"]) for r in decontaminate.keep_clean(d, bench).collect()) == ["1", "2", "4", "5"]
    assert decontaminate.keep_clean(d, bench).columns == d.columns
    for df in (pii_surrogates.pseudonymise(d, "key"), line_dedup.line_dedup(d), toxicity.keep_clean(d, None)):
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect()) == sorted((str(i), str(t)) for i, t, _ in ODD)
    joined = jaccard_join.jaccard_join(d).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in joined) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, 0)]
    scanned = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) for r in licenses.license_scan(d).collect()}
    assert scanned[1] == scanned[2] == scanned[4] == (0, 0, None, "", 0.0) and scanned[3] == scanned[None] == (1, 0, None, "", 0.0)
    coded = {r["doc_id"]: r for r in sentencepiece_lattice.encode(d, sentencepiece_lattice.Model.load(TOKENIZER)).collect()}
    assert coded[1]["ids"] is None and coded[1]["round_trip"] is None and coded[2]["ids"] == [] and coded[2]["n_ids"] == 0 and all(coded[i]["round_trip"] for i in (2, 3, 4, 5)) and text[5]
    model = sentencepiece_lattice.Model.load(TOKENIZER)
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(d, model).withColumn("decoded", F.lit(1)), model)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == text
    assert {r["score"] for r in toxicity.score(d, None).collect()} == {0.0}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "one two", "en", None, 7), (3, "a b c d e f g", None, "s", 13), (3, "a b c d e f g", None, "s", 13), (4, "a b c d e f g", "en", "s", None)]])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    folder = f"{tmp_path}/t"
    spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("_doc", F.lit(2)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", "kept", "_doc"}
        left.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    everything = sorted(str(r[0]) for r in rows)
    assert left[:2] == [everything] * 2
    assert left[2:] == [sorted({"1", "2", "None", "3"} if rows else set())] * 2
    coded = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in coded) == left[-1] and all(r["round_trip"] in (True, None) for r in coded)
