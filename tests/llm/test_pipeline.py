"""The stages of the pipeline together, and the cases that only meet there."""

from collections import Counter

import pytest

import corpus_pipeline
from sunframe.llm import curriculum, simhash


@pytest.fixture(scope="module")
def folder(tmp_path_factory, odd_docs):
    path = tmp_path_factory.mktemp("odd")
    odd_docs.write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_run_on_odd_rows_and_on_a_table(spark, folder, sf):
    for place in (folder, sf):
        docs = spark.read.parquet(f"{place}/documents.parquet")
        out = corpus_pipeline.run(spark, place)
        assert out.columns and out.count() > 0
        assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}


def test_stages_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_sources_without_words(spark):
    """A source of empty and missing texts has target 0; so has a table of nothing else."""
    words = [(1, "a b c", "x"), (2, "d e", "x")]
    none = [(3, "", "y"), (4, None, "y"), (5, " \t", None)]
    for rows in (words + none, none):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        report = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in curriculum.mix_report(docs).collect()}
        assert all(report[i] == (0, 0, 0.0, 0) for i in (3, 4, 5)) and len(report) == len(rows)
        mixed = Counter(r.doc_id for r in corpus_pipeline.mixture(spark, docs, "").collect())
        assert set(mixed) <= {1, 2} and bool(mixed) == (len(rows) == 5)
        assert report.get(1, (3, 5, 7.5, 0))[2] == 7.5


def test_texts_under_one_id_are_texts_of_their_own(spark):
    a, b = "one two three four five six", "quite another text with other words in it"
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, a), (None, "no name at all here"), (None, "no name at all here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_representatives(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (1, b), (None, "no name at all here")], key=repr)
