"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from collections import Counter

import plain
import pytest
from pyspark.sql import functions as F

from tickloom.llm import arrow_stream, chat, exact_dedup, jaccard, line_windows, near_copies, neighbours, packing, suffixes, toxicity, tree_bpe
from tickloom.llm.words import word_bpe_path
from tickloom.session import new_folder

key = lambda row: tuple((x is not None, x) for x in row)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def test_arrow_stream(spark, awkward, pairs, nothing):
    write = lambda docs: arrow_stream.write_documents(docs, new_folder(spark, "t"), word_bpe_path(), 2, sequence=64, batch=4)
    assert rows(arrow_stream.read_documents(write(awkward)), "start", "doc_id", "n_tokens", "ids_crc32") == sorted(
        ((s, d, n, c) for d, s, n, c in plain.streams(pairs, 2)), key=key)
    assert arrow_stream.read_documents(write(nothing)).count() == 0


def test_exact(awkward, pairs, nothing):
    found = exact_dedup.exact_groups(awkward)
    best = {}
    for d, t in pairs:
        best[t or ""] = max(best.get(t or "", (False, 0)), (d is not None, d or 0))
    size = Counter(t or "" for _, t in pairs)
    wanted = sorted(((d, best[t or ""][1] if best[t or ""][0] else None, size[t or ""], plain.sha(t or "")) for d, t in pairs), key=key)
    assert rows(found, "doc_id", "keep_id", "group_size", "text_sha256") == wanted
    assert found.filter("kept").count() == len(size)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_compares_bytes_when_digests_collide(awkward):
    weak = exact_dedup.exact_groups(awkward, digest=F.substring(F.sha2("text", 256), 1, 1))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(weak, *columns) == rows(exact_dedup.exact_groups(awkward), *columns)


def test_exact_stage_keeps_columns(awkward, pairs):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({t or "" for _, t in pairs})


def test_lines(awkward, pairs, nothing):
    seen, wanted = set(), []
    ordered = awkward.select("doc_id", "text").collect()
    found = line_windows.removed_lines(awkward)
    order = {r["row_id"]: r for r in found.collect()}
    for r in sorted(order.values(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["row_id"])):
        gone = set()
        for i in range(len(r["lines"]) - 2):
            w = tuple(r["lines"][i:i + 3])
            gone |= set(range(i, i + 3)) if w in seen else set()
            seen.add(w)
        wanted.append((r["row_id"], sorted(gone)))
    assert sorted((i, r["removed"]) for i, r in order.items()) == sorted(wanted)
    assert len(order) == len(ordered)
    kept = line_windows.without_repeated_lines(found).collect()
    assert sum(r["n_removed"] for r in kept) == sum(len(g) for _, g in wanted)
    assert line_windows.removed_lines(nothing).count() == 0


def test_packing(awkward, pairs, nothing):
    found = packing.pack_documents(awkward, word_bpe_path(), 1, capacity=512)
    assert rows(found, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(plain.pieces(pairs, 1, 512), key=key)
    places = Counter()
    for r in found.collect():
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 512
    assert packing.pack_documents(nothing, word_bpe_path(), 1).count() == 0


def test_ranks_of_a_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id as row_id", "id as doc_id", "0 as piece", "0L as start", "cast(id % 3 > 0 as int) + 7 as length", "0L as ids_crc32")
    counts = {7: 1667, 8: 3333}
    found = packing.ranked(pieces, counts, rank_rows=100).collect()
    for length, n in counts.items():
        assert sorted(r["rank"] for r in found if r["length"] == length) == list(range(n))


@pytest.mark.parametrize("most_together", [1, 10_000])
def test_suffixes(awkward, pairs, nothing, most_together):
    found = suffixes.remove_repeats(awkward, 100, most_together=most_together)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(plain.repeats(pairs, 100)[0], key=key)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_suffix_stage(awkward, pairs):
    kept = suffixes.drop_repeats(awkward, 400)
    assert kept.columns == awkward.columns
    wanted = sorted(b.decode(errors="ignore") for b in plain.repeats(pairs, 400)[1])
    assert sorted(r["text"] or "" for r in kept.collect()) == wanted


@pytest.mark.parametrize("share", [50, 16_384])
def test_tree_bpe(awkward, pairs, nothing, share):
    path = word_bpe_path()
    found = tree_bpe.digests(tree_bpe.encode_documents(awkward, path, share=share, leaf=40), path)
    assert rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(plain.encoded(pairs), key=key)
    assert tree_bpe.encode_documents(nothing, path).count() == 0


@pytest.mark.parametrize("frequent", [2, 32])
def test_jaccard(awkward, pairs, nothing, frequent):
    found = jaccard.similar_components(awkward, frequent=frequent)
    assert rows(found, "doc_id", "n_shingles", "component_id") == sorted(plain.components(pairs), key=key)
    assert jaccard.similar_components(nothing).count() == 0


def test_near_stage(awkward, pairs):
    kept = near_copies.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    groups = {(c, n > 0) if n and c is not None else ("own", i) for i, (d, n, c) in enumerate(plain.components(pairs)) if not (n and d is None)}
    nulls = sum(1 for d, n, _ in plain.components(pairs) if n and d is None)
    assert kept.count() == len(groups) + nulls


def test_neighbours(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]),
            (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0, 0.0]), (50, [1.0, 1.0]), (51, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string")
    found = rows(neighbours.nearest(table, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")
    assert [r[:3] for r in found if r[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 9)]
    assert [r[3] for r in found if r[0] == 0] == [1.0, 1.0, 0.0, -1.0]
    assert [r[:3] for r in found if r[0] == 50] == [(50, 1, 51)]
    assert neighbours.nearest(table.filter("vec_id > 1000"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_in_blocks(spark, folder, monkeypatch):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    whole = rows(neighbours.nearest(table, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id")
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 3)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    assert rows(neighbours.nearest(table, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id") == whole


def test_toxicity(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "x"), (None, 1, "x"), (2, None, "x"), (0, 1, "x")], "doc_id long, toxic int, score string")
    found = toxicity.scored(awkward, labels)
    assert found.count() == awkward.count()
    assert found.filter("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert toxicity.scored(nothing, labels).count() == 0
    assert toxicity.scored(awkward, labels.filter("doc_id > 100")).filter("predicted = 1").count() == 0
    kept = toxicity.drop_toxic(awkward, labels.filter("doc_id > 100"))
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_chat(spark):
    turns = [(1, 0, "system", "be <<SYS>> ~ kind"), (1, 1, "user", "[INST]~~</s>"), (1, 2, "assistant", "~[/INST]<s>"), (2, 0, "assistant", "first"),
             (None, 3, None, None), (None, None, "tool~[ROLE]", ""), (3, 0, "user", "x" * 100_000), (3, 0, "user", "x" * 100_000), (4, 0, "user", "a"), (4, 1, "assistant", "b")]
    table = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, loss string")
    parts = chat.segments(table)
    found = {r["conv_id"]: r for r in chat.digests(parts).collect()}
    assert {c: r["valid"] for c, r in found.items()} == {1: True, 2: False, None: False, 3: False, 4: True}
    assert found[1]["turns_sha256"] == plain.sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns[:3]))
    assert found[1]["loss_sha256"] == plain.sha("~[/INST]<s>") and found[2]["loss_chars"] == 5
    assert found[None]["turns_sha256"] == plain.sha("tool~[ROLE]\n\n\n\n") and found[3]["n_turns"] == 2
    whole = "".join(r["text"] for r in parts.filter("conv_id = 4").orderBy("segment").collect())
    assert whole == "<s>[INST] a [/INST] b </s>"
    assert chat.digests(chat.segments(table.filter("conv_id > 9"))).count() == 0
