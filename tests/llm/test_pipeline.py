import pytest

import corpus_pipeline
from groveline.llm import decontaminate, lines, quality, simhash


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{root}/{n}")
        docs = spark.read.parquet(f"{root}/{n}")
        seen.append(docs)
    return seen


def test_all_but_the_last_return_documents(steps):
    for after in steps[1:-1]:
        assert after.schema == steps[0].schema


def test_quality_drops_what_it_rejects(steps):
    judged = quality.quality(steps[0]).collect()
    assert ids(steps[1]) == sorted(r["doc_id"] for r in judged if r["kept"])


def test_line_dedup_changes_texts_only(steps):
    want = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(steps[1]).collect()}
    got = {r["doc_id"]: r for r in steps[2].collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_one_document_of_each_group_stays(steps):
    found = simhash.near_duplicates(steps[2]).collect()
    assert ids(steps[3]) == sorted({r["component_id"] for r in found})


def test_contaminated_documents_go(spark, small, steps):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    found = {r["doc_id"] for r in decontaminate.contaminated(steps[3], benchmark).collect()}
    assert ids(steps[4]) == sorted(set(ids(steps[3])) - found)
    for row in steps[4].select("text").collect():
        for item in benchmark.collect():
            assert item["text"] not in row["text"]


def test_every_word_is_packed_once(steps):
    words = {r["doc_id"]: len(r["text"].split()) for r in steps[4].collect()}
    placed = {}
    for r in steps[5].collect():
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["n_words"]
    assert placed == words


def test_run_applies_the_stages(spark, small, steps):
    run = corpus_pipeline.run(spark, small)
    assert run.columns == steps[-1].columns
    assert ids(run) == ids(steps[-1])


@pytest.mark.parametrize("number", range(5))
def test_stages_bear_edges(spark, small, edge, empty, number):
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, empty, small).collect() == []
    found = stage(spark, edge, small)
    assert len(found.collect()) > 0
    if number < 4:
        assert found.columns == edge.columns
