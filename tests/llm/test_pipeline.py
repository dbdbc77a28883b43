"""The corpus pipeline against a plain version of its stages."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from kinweave.llm import toxicity  # noqa: E402
from tests.llm import brute  # noqa: E402


def test_stages_do_what_they_say(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    labels = spark.read.parquet(f"{source}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontaminate", "pattern_packing"]
    want = {r["doc_id"]: r["text"] for r in toxicity.scores(docs, labels).filter("predicted = 0").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, source)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "line_dedup":
            want = {i: t for i, (t, _, _) in brute.lines(sorted(want.items())).items()}
        elif name == "ngram_jaccard_join":
            want = {i: want[i] for i, (_, root) in brute.classes(sorted(want.items()), 5, 80).items() if root == i}
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{source}/benchmark.parquet").select("item_id", "text").collect()]
            want = {i: want[i] for i, v in brute.contamination(sorted(want.items()), items).items() if not v[-1]}
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
        assert docs.filter(F.col("n_chars") != F.char_length("text")).isEmpty()
    packed = corpus_pipeline.run(spark, source).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    assert sum(1 for r in packed if r["piece"] == 0) == len(want)


def test_near_copies_of_one_text_leave_one(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[: i * 7] + ["new"] + base[i * 7 + 1 :]), "en", "s", 1) for i in range(4)] + [(9, "quite another text " + " ".join(base[:30]), "en", "s", 1), (10, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {0, 9, 10}


def test_pipeline_has_no_cap_in_its_source():
    text = open(corpus_pipeline.__file__, encoding="utf-8").read()
    assert not re.search(r"\.limit\(|\.sample\(", text)
