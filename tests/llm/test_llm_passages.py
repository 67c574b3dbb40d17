"""Repeated passages of over 50 words, most of them below 400 bytes, and no shorter ones."""

import random
import re
from collections import Counter

import corpus_pipeline
import plain
import pytest
from tickloom.llm import suffixes
from tickloom.llm.queries import QUERIES

WORD = re.compile(r"\w+(?:[^\w\s]+\w+)*")


def kept(texts, words, length):
    """The texts without every window of words, or of bytes, that occurs twice."""
    found = [list(WORD.finditer(t)) for t in texts]
    windows = lambda ms: [tuple(m.group() for m in ms[i:i + words]) for i in range(len(ms) - words + 1)]
    times = Counter(w for ms in found for w in windows(ms))
    raw = [t.encode() for t in texts]
    strings = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for t, b, ms in zip(texts, raw, found, strict=True):
        gone = bytearray(len(b))
        for i, w in enumerate(windows(ms)):
            if times[w] > 1:
                a, z = len(t[:ms[i].start()].encode()), len(t[:ms[i + words - 1].end()].encode())
                gone[a:z] = b"\1" * (z - a)
        for i in range(len(b) - length + 1):
            if strings[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, passages = [], {}
    for n in [*range(48, 61), 70]:
        passages[n] = prose(n)
        for end in (" ", ". ", ",\n"):
            texts.append(f"{prose(rng.randint(5, 90))} {passages[n]}{end}{prose(rng.randint(5, 90))}")
    wrapped = passages[55].replace(" ", "\n", 20)
    apart = prose(45)
    texts += [f"{prose(9)} {wrapped}", prose(400), "日本語" * 80, "x" + "日本語" * 80, f"{prose(20)} {apart}", f"{apart} {prose(20)}", "a " * 90, "", passages[52]]
    return texts, passages


def test_planted_passages_go(spark, tmp_path):
    texts, passages = planted()
    path = str(tmp_path / "docs")
    spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string").repartition(3).write.parquet(path)
    rows = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.read.parquet(path), "").collect()}
    assert rows[len(texts)] is None
    assert [rows[i] for i in range(len(texts))] == kept(texts, 51, 400)
    left = "\n".join(t or "" for t in rows.values())
    assert min(len(p.encode()) for n, p in passages.items() if n > 50) < 400
    assert all((p in left) == (n <= 50) for n, p in passages.items())


def test_query_tells_passages_below_400_bytes(spark, tmp_path):
    texts, passages = planted()
    spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in QUERIES["op7_suffix_dedup"](spark, str(tmp_path)).collect()}
    docs = [*enumerate(texts), (len(texts), None)]
    wanted, rest = plain.repeats(docs, 400)
    assert [tuple(rows[d][c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for d, _ in docs] == wanted     # the contract
    assert [rows[d]["text"] for d, _ in docs] == [b.decode(errors="ignore") for b in rest]
    assert [rows[d]["text_without_passages"] for d, _ in docs] == [*kept(texts, 51, 400), ""]
    planted_in = {i for i, t in enumerate(texts) for n, p in passages.items() if n > 50 and " ".join(p.split()) in " ".join(t.split())}
    assert any(rows[i]["n_removed"] == 0 for i in planted_in)
    assert {d for d, r in rows.items() if r["n_passages"]} == planted_in | {i for i, t in enumerate(texts) if t.startswith("a a a")}


@pytest.mark.parametrize("most_together", [1, 4_000])
def test_small_limits_against_windows(spark, tmp_path, most_together):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "bb", "c-d", "é", "e.", "-"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(path)
    got = {r["doc_id"]: r["text"] for r in suffixes.drop_passages(spark.read.parquet(path), 10, 400, most_together=most_together).collect()}
    assert [got[i] for i in range(len(texts))] == kept(texts, 10, 400)


def test_clashing_columns_and_no_rows(awkward, nothing):
    kept_rows = suffixes.drop_passages(awkward)
    assert kept_rows.columns == awkward.columns and kept_rows.count() == awkward.count()
    assert suffixes.drop_passages(nothing).count() == 0
