"""The registered queries against their SQL, or against plain Python where SQL cannot say it."""

import numpy as np
import plain
import pytest
from compare import assert_same

from tickloom.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(name, spark, duck, folder):
    assert_same(QUERIES[name](spark, folder), duck, CHECKS[name])


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def _docs(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_arrow_stream(spark, folder):
    found = QUERIES["op1_arrow_stream"](spark, folder)
    assert _rows(found, "doc_id", "start", "n_tokens", "ids_crc32") == plain.streams(_docs(spark, folder), 2)


def test_packing(spark, folder):
    rows = QUERIES["op5_lp_packing"](spark, folder).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(plain.pieces(_docs(spark, folder), 1, 4096))
    total, sequences = sum(r["length"] for r in rows), {r["sequence_id"] for r in rows}
    assert len(sequences) <= -(-total // 4096) * 1.02 + 1
    for s in sequences:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_suffix_dedup(spark, folder):
    found = QUERIES["op7_suffix_dedup"](spark, folder)
    assert _rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(plain.repeats(_docs(spark, folder), 400)[0])


def test_tree_bpe(spark, folder):
    found = QUERIES["op8_tree_bpe"](spark, folder)
    assert _rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(plain.encoded(_docs(spark, folder)))


def test_neighbours_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r["query_id"], r["rank"]): r for r in QUERIES["op2_neighbours"](spark, folder).collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        best = set(ids[np.argsort(-score)[:5]].tolist())
        own = [found[int(ids[i]), k] for k in range(1, 6)]
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
        for r in own:
            assert abs(score[ids == r["vec_id"]][0] - r["score"]) < 1e-12
        hits, total = hits + len(best & {r["vec_id"] for r in own}), total + 5
    assert hits / total >= 0.95


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    held = [(found[d]["predicted"], y) for d, y in labels if found[d]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert all(p == 0 for p, y in held if y == 0)
