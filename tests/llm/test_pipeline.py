import hashlib

import corpus_pipeline
import pytest
from tests.llm.conftest import prose


@pytest.fixture
def folder(spark, tmp_path, documents):
    """A small corpus with planted cases; the stages read labels and benchmark from the folder."""
    good = [(i, prose(i, 80 + i)) for i in range(60)]
    near = [(100 + i, good[i][1] + " tail") for i in range(10)] + [(200, good[3][1])]
    junk = [(300 + i, " ".join(w + "###" for w in prose(700 + i, 90).split())) for i in range(40)]
    passage = prose(4321, 30)
    dirty = [(400, prose(800, 50) + " " + passage), (401, passage)]
    private = [(500, prose(900, 60) + " write to someone@mail.example.com now")]
    documents([*good, *near, *junk, *dirty, *private], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "only words of its own"), (3, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/{hashlib.md5(name.encode()).hexdigest()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    good = set(range(60))
    assert good <= set(seen["quality classifier"]) and not {300 + i for i in range(40)} & set(seen["quality classifier"])
    assert set(seen["near duplicates"]) == good | {400, 401, 500}
    assert set(seen["decontamination"]) == good | {500}
    assert set(seen["personal data"]) == good | {500}
    assert "<EMAIL>" in seen["personal data"][500] and all(seen["personal data"][i] == prose(i, 80 + i) for i in good)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == good | {500}


def test_odd_rows_pass_every_stage(spark, folder, documents, odd_texts):
    docs = documents(odd_texts)
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= len(odd_texts)
        assert function(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(odd_texts)
