"""The stages of the pipeline against a plain version of each."""

import re

import sentencepiece

import corpus_pipeline
from lantern.llm.queries import TOKENIZER

from .test_llm import brute_classes, toxic_rows

LEAK = "a passage of the benchmark that nobody should ever have seen in training data at all"


def normal(text):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


def test_pipeline(spark, tmp_path):
    rows, labels = toxic_rows(160)
    toxic = {i for i, y in labels if y}
    letters = str.maketrans("0123456789", "abcdefghij")  # numbers would all be one variable field
    texts = {i: t.translate(letters) + f"\nRead more about us on this page {i}" * (i % 16 == 1) for i, t in rows}
    texts |= {1000 + i: texts[i] for i in (1, 2, 3)} | {2000: texts[5] + " " + LEAK.upper() + "!", 2001: "plain words that nothing is wrong with"}
    documents = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, stages = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        held = stages[name] = spark.read.parquet(f"{tmp_path}/{name}")
    left = {n: {r["doc_id"]: r for r in df.collect()} for n, df in stages.items()}
    names = list(left)
    assert set(left[names[0]]) == set(texts) - toxic
    bare = {i: texts[i].split("\nRead more")[0] for i in left[names[0]]}
    assert {i: r["text"] for i, r in left[names[1]].items()} == bare
    classes = brute_classes(list(bare.items()))
    assert set(left[names[2]]) == {i for i, (c, _) in classes.items() if c == i}
    clean = {i for i in left[names[2]] if normal(LEAK) not in normal(bare[i])}
    assert set(left[names[3]]) == clean and 2000 not in clean and 2001 in clean
    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    assert {i: r["ids"] for i, r in left[names[4]].items()} == {i: lib.encode(bare[i]) for i in clean}
    assert all(stages[n].columns == documents.columns for n in names[:4])
