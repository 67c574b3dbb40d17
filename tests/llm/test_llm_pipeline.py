"""Every stage of the pipeline against plain Python over its own input."""

import corpus_pipeline
import plain
import pytest
from test_llm_passages import kept

from tickloom.llm import toxicity


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(i))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_columns(steps):
    for rows in steps[1:-1]:
        assert set(rows[0]) == set(steps[0][0])


def test_toxic_rows_go(spark, folder, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    left = {r["doc_id"] for r in steps[1]}
    assert all(d in left for d, y in labels.items() if y == 0)
    toxic = [d for d, y in labels.items() if y == 1]
    spoken = {r["doc_id"] for r in steps[0] if toxicity.Voters(()).counts(r["text"]).any()}      # four of the eleven hold no such word at all
    assert len(spoken & set(toxic)) >= 7
    assert all(d not in left for d in toxic if d in spoken)


def test_exact_copies_go(steps):
    last = {}
    for r in steps[1]:
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    assert {r["doc_id"] for r in steps[2]} == set(last.values())


def test_one_near_copy_stays(steps):
    found = plain.components([(r["doc_id"], r["text"]) for r in steps[2]])
    assert {r["doc_id"] for r in steps[3]} == {d if not n else c for d, n, c in found}


def test_repeated_passages_go(steps):
    pairs = [(r["doc_id"], r["text"]) for r in steps[3]]
    wanted = dict(zip([d for d, _ in pairs], kept([t or "" for _, t in pairs], 51, 400), strict=True))     # the rule in force: 51 words or 400 bytes
    assert {r["doc_id"]: r["text"] or "" for r in steps[4]} == wanted


def test_all_that_is_left_is_packed(steps):
    pairs = [(r["doc_id"], r["text"]) for r in steps[4]]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in steps[5]) == sorted(plain.pieces(pairs, 1, 4096))
