"""Algorithms without Spark, against definitions."""

import io
import itertools
import random

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import arrow_stream, chat, jaccard, neighbours, packing, shingles, suffixes, toxicity, tree_bpe
from tickloom.llm.grouping_sort import suffix_array
from tickloom.llm.words import encoder, word_bpe_path

settings.register_profile("short", deadline=None, max_examples=150)
settings.load_profile("short")

ODD = st.sampled_from(["ab", "aaaa", "the", "'s", "'", "!!", "é", "é", "Σ", "İ", " ", "\n", "1", "23", "<|endoftext|>", "<|", "日本", "ﬁ", " ", "lo", "Z"])


@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    symbols = [*symbols, 0]
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@given(st.lists(ODD, max_size=120).map("".join), st.integers(1, 40))
def test_tree_of_any_leaf_size(text, leaf):
    enc = encoder(word_bpe_path())
    assert tree_bpe.encode_text(enc, text, leaf).tolist() == plain.ids(text)


@given(st.lists(ODD, max_size=60).map("".join))
def test_decoder(text):
    assert tree_bpe.Decoder(word_bpe_path()).text(plain.ids(text)) == plain.TOKENIZER.decode(plain.ids(text), skip_special_tokens=False)


@given(st.lists(st.integers(0, 300), max_size=20), st.booleans())
def test_stream_round_trip(sizes, wide):
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 60_000, n).astype("u4") for n in sizes]
    sink = io.BytesIO()
    writer = arrow_stream.StreamWriter(sink, sequence=16, batch=4, wide=wide)
    places = []
    for r in runs:
        places.append(writer.place)
        writer.append(r)
    writer.close()
    batches = list(pa.ipc.open_stream(sink.getvalue()))
    assert all(b.num_rows == 4 for b in batches[:-1])
    ids = np.concatenate([b.column("ids").flatten().to_numpy() for b in batches] or [np.zeros(0)])
    mask = np.concatenate([b.column("mask").flatten().to_numpy(zero_copy_only=False) for b in batches] or [np.zeros(0, bool)])
    assert mask.sum() == sum(sizes) and ids[mask].tolist() == [x for r in runs for x in r.tolist()]


def test_stream_random_access(tmp_path):
    path = str(tmp_path / "x.arrows")
    with open(path, "wb") as sink:
        writer = arrow_stream.StreamWriter(sink, sequence=8, batch=2)
        writer.append(np.arange(100, dtype="u4"))
        writer.close()
    reader = arrow_stream.StreamReader(path)
    for place, n in [(0, 100), (15, 2), (99, 1), (31, 40), (5, 0)]:
        assert reader.run(place, n).tolist() == list(range(place, place + n))
    ids, mask = reader.sequence_at(12)
    assert ids.tolist() == [96, 97, 98, 99, 0, 0, 0, 0] and mask.tolist() == [True] * 4 + [False] * 4


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_packing_plan(histogram):
    plan = packing.solve(histogram, 64, rounds=30)
    packed: dict[int, int] = {}
    for config, n in plan:
        assert sum(length * k for length, k in config) <= 64
        for length, k in config:
            packed[length] = packed.get(length, 0) + k * n
    assert packed == histogram
    best = sum(n for _, n in packing.best_fit(histogram, 64))
    assert sum(n for _, n in plan) <= best * 1.05 + 1


def test_knapsack():
    counts = packing.price_knapsack(np.array([5, 4, 3]), np.array([6.0, 4.5, 3.2]), np.array([1, 1, 3]), 11)
    assert counts.tolist() == [1, 0, 2]


@given(st.lists(st.sampled_from(["a", "B", "cc", " ", "\t", "\x0b", "\x1c", "é", " "]), max_size=60).map("".join), st.text(max_size=20))
def test_shingle_counts(one, two):
    found = shingles.shingle_sets([t.encode() for t in (one, two, one)])
    assert [len(s) for s in found] == [len(plain.shingles(t)) for t in (one, two, one)]
    assert found[0].tolist() == found[2].tolist()


@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), max_size=8), st.integers(0, 60))
def test_similar_sets_share_a_signature(base, change, rare_from):
    """Whatever the classes of the tokens are."""
    other = base ^ change
    if not other or base == other or 100 * len(base & other) < 80 * len(base | other):
        return
    known = np.arange(rare_from, 61, dtype="u8")
    classes = np.full(len(known), 5, "u1")
    sigs = []
    for s in (base, other):
        tokens, rare = jaccard.ordered(np.array(sorted(s), "u8"), 1, known, classes)
        sigs.append(set(jaccard.signatures(tokens, rare).tolist()))
    assert sigs[0] & sigs[1]


@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_smallest(values, width):
    if len(values) >= width:
        wanted = [min(values[i:i + width]) for i in range(len(values) - width + 1)]
        assert suffixes.sliding_smallest(np.array(values, "u8"), width).tolist() == wanted


@given(st.text(alphabet="~[]</>sINT SYROLE", max_size=60))
def test_escapes_are_reversible(text):
    escaped = chat.INSTRUCT.escaped(text)
    assert chat.INSTRUCT.unescaped(escaped) == text
    assert not any(c in escaped for c in chat.INSTRUCT.controls)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.2
    good = [np.where(truth, rng.random(4000) < 0.8, rng.random(4000) < 0.02) for _ in range(4)]
    noise = np.where(truth, rng.random(4000) < 0.3, rng.random(4000) < 0.25)
    posterior = toxicity.label_model(np.stack([*good, *[noise] * 5], 1), np.where(rng.random(4000) < 0.03, ~truth, truth), 0.2)
    assert ((posterior > 0.5) == truth).mean() > 0.98


def test_words_of_the_same_letters_differ():
    words = [bytes(w) for w in itertools.permutations(b"abcdef")]
    hashes, owner = shingles.word_hashes([b" ".join(words)])
    assert len(set(hashes.tolist())) == len(words) and set(owner.tolist()) == {0}


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_of_any_vocabulary(file):
    rng, path = random.Random(9), public_tokenizers.path(file)
    enc = encoder(path)
    assert enc.cached == file.startswith("word")
    parts = ["Hello", " ", "\n", "don't", "é", "1", "23", "  ", "<|endoftext|>", "ß", " ", "x", "İ", "日本"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
