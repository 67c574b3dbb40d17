"""BPE encoding by tree concatenation, and decoding.

A text is cut into parts without looking for word borders.  Parts are encoded
on their own and neighbours are joined in a tree: a window around the join is
encoded anew and grows until, on either side, a token of the window is also a
token of that side (same place, same id) and of that side encoded alone.  Since
a sequence of BPE tokens is right when every neighbouring pair is, the tokens
outside the window may stay.  Texts longer than one task's share are cut into
rows first, so the parts of one long text are encoded by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import numbered, sliced
from tickloom.llm.words import WordEncoder, encoder

LEAF = 2_048            # characters encoded in one go
SHARE = 16_384          # characters of one text that one row carries
WINDOW = 24             # characters on either side of a join at first

Node = tuple[str, np.ndarray]


def join_nodes(enc: WordEncoder, left: Node, right: Node, window: int = WINDOW) -> Node:
    """The node of both texts together; equal to encoding them in one go."""
    (a, a_ids), (b, b_ids) = left, right
    if not a or not b:
        return (a + b, np.concatenate([a_ids, b_ids]))
    reach = window
    while reach < len(a) or reach < len(b):
        tail_text, head_text = a[-reach:], b[:reach]
        seam, tail, head = enc.tokenizer.encode_batch([tail_text + head_text, tail_text, head_text], add_special_tokens=False)
        place = {(s, e, t): i for i, ((s, e), t) in enumerate(zip(seam.offsets, seam.ids, strict=True))}
        begin, kept = _left_agreement(place, tail, a_ids) if reach < len(a) else (0, 0)
        end, skipped = _right_agreement(place, head, b_ids, len(tail_text)) if reach < len(b) else (len(seam.ids), len(b_ids))
        if begin is not None and end is not None and begin <= end:
            return a + b, np.concatenate([a_ids[:kept], np.array(seam.ids[begin:end], "<u4"), b_ids[skipped:]])
        reach *= 2
    return a + b, enc.ids(a + b)


def _left_agreement(place, tail, ids) -> tuple[int | None, int]:
    """Where the window takes over from the left side: token of the window, tokens of the side that stay."""
    spans, own = tail.offsets, tail.ids
    n = len(own)
    same = 0
    while same < min(n, len(ids)) and own[n - 1 - same] == ids[len(ids) - 1 - same]:
        same += 1
    for j in range(n - same, n - 1):
        at = place.get((*spans[j], own[j]))
        if at is not None and place.get((*spans[j + 1], own[j + 1])) == at + 1:
            return at, len(ids) - (n - j)
    return None, 0


def _right_agreement(place, head, ids, shift: int) -> tuple[int | None, int]:
    """Where the right side takes over: one past the window's last token, tokens of the side that go."""
    spans, own = head.offsets, head.ids
    same = 0
    while same < min(len(own), len(ids)) and own[same] == ids[same]:
        same += 1
    for k in range(same - 1, 0, -1):
        at = place.get((spans[k][0] + shift, spans[k][1] + shift, own[k]))
        before = place.get((spans[k - 1][0] + shift, spans[k - 1][1] + shift, own[k - 1]))
        if at is not None and before == at - 1:
            return at + 1, k + 1
    return None, 0


def join_all(enc: WordEncoder, nodes: list[Node]) -> Node:
    """Joins neighbours level by level."""
    while len(nodes) > 1:
        paired = [join_nodes(enc, nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
        nodes = paired + nodes[len(paired) * 2:]
    return nodes[0] if nodes else ("", np.zeros(0, "<u4"))


def encode_text(enc: WordEncoder, text: str | None, leaf: int = LEAF) -> np.ndarray:
    text = text or ""
    if len(text) <= leaf:
        return enc.ids(text)
    parts = [text[i:i + leaf] for i in range(0, len(text), leaf)]
    return join_all(enc, [(p, enc.ids(p)) for p in parts])[1]


def encode_documents(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", share: int = SHARE, leaf: int = LEAF
) -> DataFrame:
    """row_id, doc_id, ids (binary, little-endian unsigned 32 bit) of every row.

    A null text is an empty one and gives no ids.  Rows are told apart by
    where they are stored, so ids may be null or repeat.
    """
    texts = numbered(docs, doc_id=id_column, text=text_column)
    size = F.coalesce(F.length("text"), F.lit(0))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in sliced(batches):
            ids = [encode_text(enc, t, leaf).tobytes() for t in batch.column("text").to_pylist()]
            kept = [n for n in batch.schema.names if n != "text" or "part" in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(ids, pa.binary())], [*kept, "ids"])

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(tokenizer)
        rows = rows.sort_values("part")
        nodes = [(t, np.frombuffer(i, "<u4")) for t, i in zip(rows["text"], rows["ids"], strict=True)]
        out = rows.head(1)[["row_id", "doc_id"]]
        return out.assign(ids=[join_all(enc, nodes)[1].tobytes()])

    short = texts.filter(size <= share).mapInArrow(encode, "row_id long, doc_id long, ids binary")
    part = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / share).cast("int"))).alias("part")
    cut = (
        texts.filter(size > share)
        .select("row_id", "doc_id", part, "text")
        .withColumn("text", F.substring("text", F.col("part") * share + 1, F.lit(share)))
        .repartition("row_id", "part")
    )
    long = (
        cut.mapInArrow(encode, "row_id long, doc_id long, part int, text string, ids binary")
        .groupBy("row_id")
        .applyInPandas(assemble, "row_id long, doc_id long, ids binary")
    )
    return short.unionByName(long)


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by spaces and of the decoded text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokenizer)
        for batch in sliced(batches):
            lists = [np.frombuffer(i, "<u4").tolist() for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([_sha(" ".join([decoder.decimal[i] for i in x])) for x in lists], pa.string()),
                    pa.array([_sha(decoder.text(x)) for x in lists], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class Decoder:
    """``text(ids)`` equals the library's ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, tokenizer: str):
        self.library = encoder(tokenizer).tokenizer
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.decimal = [str(i) for i in range(size)]
        self.joined = self.library.decoder is None      # then tokens are joined by spaces as they are
        self.tokens = [self.library.id_to_token(i) for i in range(size)]

    def text(self, ids: list[int]) -> str:
        if self.joined:
            return " ".join([self.tokens[i] for i in ids])
        return self.library.decode(ids, skip_special_tokens=False)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
