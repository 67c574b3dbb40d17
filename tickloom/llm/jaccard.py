"""Join of documents whose five-word shingles overlap by 80 % or more, by token-combination prefixes.

Tokens (shingles) are put in one order for all documents: rare ones first, then
classes of frequent ones by how many documents hold them.  Two similar sets of
sizes n share a token among the first n/5 + 1 of each.  Where that prefix holds
only rare tokens, each of them is a signature on its own.  Where it reaches
into the frequent classes it is extended to 2n/5 + 2 tokens, and neighbouring
pairs of tokens that hold a frequent one are signatures: of the pairs that the
larger prefix has, dissimilar tokens can break at most 2n/5, so one is left.

Documents that share a signature are candidates.  A parity bitmap of each set
bounds from above what two sets can have in common, so most candidates fall
without a look at their texts; the others are verified on their whole sets.
Equal sets are one node from the start.  Only connectedness is asked for, so
candidates first meet the first document of their lists.  After that lists that
hold several components give the likeliest pairs between them, more from round
to round, until none that may be similar is left, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import blobs
from tickloom.llm.components import components
from tickloom.llm.rows import numbered, settled
from tickloom.llm.shingles import in_portions, set_key, shingle_sets

FREQUENT = 32               # documents from which on a token is frequent
MOST_FREQUENT = 1 << 18     # frequent tokens that are told to all tasks; further ones are treated as rare
MEMBERS = 64                # documents verified against one in one task
TOGETHER = 1_024            # members of a list compared by bitmap in one task
MOST_BITS = 1 << 16

SETS = "bucket int, packed binary, row_id long, doc_id long, n long, cls long, bits binary"
POSTING = np.dtype([("sig", "<u4"), ("cls", "<i8")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    for batch in batches:
        rows, ids = batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist()
        for first, texts in in_portions(batch.column("text").to_pylist()):
            sets = shingle_sets(texts)
            yield rows[first:first + len(sets)], ids[first:first + len(sets)], sets


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype("i4")


def _low(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype("u4")


def _key(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (bucket.astype("u8") << np.uint64(32)) | low.astype("u8")


def bitmap(tokens: np.ndarray) -> bytes:
    """For each remainder of the tokens whether an odd number of them has it; about two bits a token."""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(tokens) - 1).bit_length())) if len(tokens) else 64
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (a row each) brought to ``size`` words."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def odd_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps (rows) differ; each takes at least one token that only one of the sets has."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype="i8")


def may_link(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Rows of two arrays of bitmaps that can belong to sets with 80 % in common: these differ in a ninth of their summed sizes at most."""
    return 9 * odd_bits(a, b) <= a_n + b_n


def describe(texts: DataFrame, buckets: int, frequent: int) -> DataFrame:
    """Written table: a row per document with its set's key and size, and a row per frequent token with its count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, sets in _sets(batches):
            keys = [set_key(s) for s in sets]
            n = len(sets)
            everything = np.concatenate(sets)
            dealt = blobs.deal(_low(everything), _bucket(everything, buckets))
            k = len(dealt)
            bucket = [r % buckets for r in rows] + [b for b, _ in dealt]
            columns = [
                pa.array(bucket, pa.int32()), pa.array([None] * n + [p for _, p in dealt], pa.binary()),
                pa.array(rows + [None] * k, pa.int64()), pa.array(ids + [None] * k, pa.int64()),
                pa.array([len(s) for s in sets] + [None] * k, pa.int64()),
                pa.array(keys + [None] * k, pa.int64()), pa.array([bitmap(s) for s in sets] + [None] * k, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SETS.split(", ")])

    def count(table: pa.Table) -> pa.Table:
        told = pc.is_valid(table.column("packed"))
        bucket = table.column("bucket")[0].as_py()
        documents, packed = table.filter(pc.invert(told)), table.filter(told)
        tokens, n = np.unique(blobs.unpack(packed, np.dtype("<u4")), return_counts=True)
        tokens, n = tokens[n >= frequent], n[n >= frequent]
        k, d = len(tokens), documents.num_rows
        none = pa.nulls(k, pa.int64())
        token = _key(np.full(k, bucket), tokens).astype("i8")
        both = lambda name: pa.concat_arrays([documents.column(name).combine_chunks(), none])
        return pa.table({
            "row_id": both("row_id"), "doc_id": both("doc_id"), "n": both("n"), "cls": both("cls"), "bits": pa.concat_arrays([documents.column("bits").combine_chunks(), pa.nulls(k, pa.binary())]),
            "token": pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(token)]),
            "count": pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(n.astype("i8"))]),
        })

    schema = "row_id long, doc_id long, n long, cls long, bits binary, token long, count long"
    return settled(texts.mapInArrow(send, SETS).groupBy("bucket").applyInArrow(count, schema))


def ordered(tokens: np.ndarray, buckets: int, known: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens in the order all documents share, and how many of them are rare."""
    level = np.zeros(len(tokens), "u1")
    if len(known) and len(tokens):
        key = _key(_bucket(tokens, buckets), _low(tokens))
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        level = np.where(known[at] == key, classes[at], 0)
    order = np.lexsort((tokens, level))
    return tokens[order], int((level == 0).sum())


def signatures(tokens: np.ndarray, rare: int) -> np.ndarray:
    """Signatures of one set, given in order with its rare tokens first.

    Sets of fewer than four tokens are similar to equal sets only and have none.
    """
    n = len(tokens)
    if n < 4:
        return tokens[:0]
    prefix = n // 5 + 1
    if rare >= prefix:
        return tokens[:prefix]
    extended = 2 * n // 5 + 2
    first = max(0, rare - 1)
    pairs = blobs.spread(tokens[first:extended - 1] * np.uint64(0x9FB21C651E98DF25) + blobs.spread(tokens[first + 1:extended]))
    return np.concatenate([tokens[:rare], pairs])


def postings(texts: DataFrame, buckets: int, frequent: Broadcast) -> DataFrame:
    """Written table of signatures that several sets have: sig, cls, leader (the smallest of the sets), size and key of the list."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = frequent.value
        seen: set[int] = set()
        for _, _, sets in _sets(batches):
            own, cls = [], []
            for tokens in sets:
                key = set_key(tokens)
                if key not in seen:
                    seen.add(key)
                    found = signatures(*ordered(tokens, buckets, known, classes))
                    own.append(found)
                    cls.append(np.full(len(found), key, "i8"))
            if not own:
                continue
            sig = np.concatenate(own)
            records = np.zeros(len(sig), POSTING)
            records["sig"], records["cls"] = _low(sig), np.concatenate(cls)
            yield blobs.batch(blobs.deal(records, _bucket(sig, buckets)))

    def group(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        records = blobs.unpack(table, POSTING)
        order = np.lexsort((records["cls"], records["sig"]))
        sig, cls = records["sig"][order], records["cls"][order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
        sig, cls = sig[new], cls[new]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        leader = np.repeat(cls[starts], sizes)
        members = blobs.spread(np.add.reduceat(blobs.spread(cls.astype("u8")), starts) + sizes.astype("u8")) if len(sig) else cls
        shared = np.repeat(sizes, sizes) > 1
        return pa.table({
            "sig": _key(np.full(len(sig), bucket), sig)[shared].astype("i8"), "cls": cls[shared], "leader": leader[shared],
            "size": np.repeat(sizes, sizes)[shared].astype("i8"), "members": np.repeat(members, sizes)[shared].astype("i8"),
        })

    schema = "sig long, cls long, leader long, size long, members long"
    return settled(texts.mapInArrow(send, blobs.SCHEMA).groupBy("bucket").applyInArrow(group, schema))


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b whose bitmaps leave a link possible; ``sets`` has cls, n, bits."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, "u8")[None] for x in batch.column(f"{c}_bits").to_pylist()] for c in "ab")
            a_n, b_n = (batch.column(f"{c}_n").to_numpy() for c in "ab")
            near = 9 * np.abs(a_n - b_n) <= a_n + b_n
            for i in np.flatnonzero(near):
                size = min(a[i].shape[1], b[i].shape[1])
                near[i] = may_link(folded(a[i], size), a_n[i], folded(b[i], size), b_n[i])[0]
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(look, "a long, b long")


def across(open_: DataFrame, sets: DataFrame, buckets: int, most: int) -> DataFrame:
    """Written table a > b, sig: in each list the ``most`` likeliest pairs between any two components that may be similar.

    ``open_`` has sig, cls, component.  Rows without a pair name the lists in
    which pairs were left for another round.  Long lists are cut into parts,
    and every two parts meet in a task of their own.
    """
    parts = open_.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (
        open_.join(parts, "sig").withColumn("own", own).withColumn("other", other)
        .select("sig", "cls", "component", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        .join(sets, "cls")
        .withColumn("bucket", F.pmod(F.xxhash64("sig", "x", "y"), F.lit(buckets)).cast("int"))
    )

    def meet(table: pa.Table) -> pa.Table:
        cls, component, n, own = (table.column(c).to_numpy() for c in ("cls", "component", "n", "own"))
        bits = [np.frombuffer(x, "u8") for x in table.column("bits").to_pylist()]
        width = np.array([len(x) for x in bits])
        place = np.stack([table.column(c).to_numpy() for c in ("sig", "x", "y")])
        order = np.lexsort((n, *place[::-1]))
        new = np.flatnonzero(np.r_[True, (place[:, order[1:]] != place[:, order[:-1]]).any(axis=0)])
        found: set[tuple[int, int]] = set()
        again: set[int] = set()
        for s, e in zip(new, np.r_[new[1:], len(order)], strict=True):
            group = order[s:e]
            split = place[1, group[0]] != place[2, group[0]]
            one, two, apart = [], [], []
            for k in range(len(group)):
                i = group[k]
                rest = group[k + 1:]
                rest = rest[: np.searchsorted(n[rest], 1.25 * n[i], "right")]      # sizes ascend
                rest = rest[component[rest] != component[i]]
                if split:
                    rest = rest[own[rest] != own[i]]
                for size in np.unique(width[rest]):
                    some = rest[width[rest] == size]
                    narrow = min(size, width[i])
                    differ = odd_bits(folded(np.stack([bits[j] for j in some]), narrow), folded(bits[i][None], narrow))
                    near = 9 * differ <= n[some] + n[i]
                    one.append(np.full(int(near.sum()), i))
                    two.append(some[near])
                    apart.append(differ[near] / (n[some[near]] + n[i]))
            if not one or not (i := np.concatenate(one)).size:
                continue
            j, d = np.concatenate(two), np.concatenate(apart)
            low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
            best = np.lexsort((d, high, low))
            i, j, low, high = i[best], j[best], low[best], high[best]
            first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            size = np.diff(np.r_[first, len(i)])
            rank = np.arange(len(i)) - np.repeat(first, size)
            if size.max() > most:
                again.add(int(place[0, group[0]]))
            for k in np.flatnonzero(rank < most):
                found.add((max(int(cls[i[k]]), int(cls[j[k]])), min(int(cls[i[k]]), int(cls[j[k]]))))
        rows = [(a, b, None) for a, b in sorted(found)] + [(None, None, sig) for sig in sorted(again)]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("a", "b", "sig"), columns, strict=True)})

    return settled(dealt.repartition("bucket").groupBy("bucket").applyInArrow(meet, "a long, b long, sig long"))


def verify(pairs: DataFrame, texts: DataFrame, documents: DataFrame, buckets: int) -> DataFrame:
    """Written table of pairs a, b with ``linked``: whether 100 * intersection >= 80 * union of the whole sets.

    Rows of a side b meet it in groups of ``MEMBERS``, so a set that many
    others are compared with is copied, not collected into one task.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "b").select(F.col("a").alias("cls"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    leaders = sizes.select(F.col("b").alias("cls"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = settled(dealt.union(leaders))
    one = documents.join(wanted.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("row_id").alias("row_id"))
    live = texts.select("row_id", "text").join(one, "row_id").select("cls", "text")
    rows = wanted.join(live, "cls").withColumn("bucket", F.pmod(F.xxhash64("b", "part"), F.lit(buckets)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        cls, b, part = (table.column(c).to_numpy() for c in ("cls", "b", "part"))
        sets: list[np.ndarray] = []
        for _, portion in in_portions(table.column("text").to_pylist()):
            sets += shingle_sets(portion)
        order = np.lexsort((part, b))
        new = np.flatnonzero(np.r_[True, (b[order[1:]] != b[order[:-1]]) | (part[order[1:]] != part[order[:-1]])])
        out = []
        for s, e in zip(new, np.r_[new[1:], len(order)], strict=True):
            group = order[s:e]
            at = group[cls[group] == b[group[0]]][0]
            for i in group[group != at]:
                both = len(np.intersect1d(sets[at], sets[i], assume_unique=True))
                out.append((int(cls[i]), int(b[i]), 100 * both >= 80 * (len(sets[at]) + len(sets[i]) - both)))
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "linked": pa.array(columns[2], pa.bool_())})

    return settled(rows.groupBy("bucket").applyInArrow(compare, "a long, b long, linked boolean"))


def similar_components(
    docs: DataFrame, frequent: int = FREQUENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links (null ids do not
    count).  Texts without a word, null or empty, are linked with nothing and
    keep their own id.  Only connectedness is computed: pairs of sets that are
    connected already are not compared, so links are not counted.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = blobs.bucket_count(spark)
    texts = numbered(docs, doc_id=id_column, text=text_column)
    described = describe(texts, buckets, frequent)
    documents = described.filter("token is null")
    lists = postings(texts, buckets, _frequent(spark, described.filter("token is not null")))
    sets = settled(
        documents.join(lists.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    )

    # every set meets one document, the one it shares most lists with of those that may be similar
    pairs = lists.filter("cls <> leader").groupBy(F.col("cls").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    near = settled(plausible(pairs.select("a", "b"), sets).join(pairs, ["a", "b"]))
    best = near.groupBy("a").agg(F.max_by("b", F.struct("lists", -F.col("b"))).alias("b"))
    checked = verify(best, texts, documents, buckets)
    labels = components(checked.filter("linked"))

    # lists that still hold several components: the likeliest pairs between them, then more; of two sets the pair is known
    kinds = lists.filter("size > 2").groupBy("members").agg(F.min("sig").alias("sig"))       # lists of the same sets: one of them
    open_ = settled(lists.join(kinds, "sig", "left_semi").select("sig", "cls"))
    most = 1
    while True:
        member = open_.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("component", "cls").alias("component"))
        split = member.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("sig")
        found = across(settled(member.join(split, "sig")), sets, buckets, most)
        checked, labels = _checked_too(found.filter("sig is null").select("a", "b").distinct(), checked, labels, texts, documents, buckets)
        left = found.filter("sig is not null").select("sig").distinct()
        if left.isEmpty():
            break
        open_, most = settled(open_.join(left, "sig", "left_semi")), most * 32
    pairs_of_two = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    checked, labels = _checked_too(pairs_of_two, checked, labels, texts, documents, buckets)

    nodes = documents.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = nodes.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return (
        nodes.join(smallest, "component", "left")
        .select(
            "row_id", "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def _frequent(spark: SparkSession, tokens: DataFrame) -> Broadcast:
    """The most frequent tokens, at most ``MOST_FREQUENT``, with their class (the order of magnitude of their count)."""
    found = tokens.orderBy(F.desc("count"), "token").select("token", "count").limit(MOST_FREQUENT).toPandas()
    keys, counts = found["token"].to_numpy("i8").astype("u8"), found["count"].to_numpy("f8")
    order = np.argsort(keys)
    return spark.sparkContext.broadcast((keys[order], np.log2(counts[order]).astype("u1")))


def _checked_too(pairs: DataFrame, checked: DataFrame, labels: DataFrame, texts: DataFrame, documents: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Verifies those of the pairs a > b that lie in different components and are new; all that is verified, and the components then."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(
        F.coalesce("a_component", "a") != F.coalesce("b_component", "b")
    )
    seen = checked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    new = settled(apart.select("a", "b").join(seen, ["a", "b"], "left_anti"))
    if new.isEmpty():
        return checked, labels
    verified = verify(new, texts, documents, buckets)
    checked = checked.union(verified)
    if verified.filter("linked").isEmpty():
        return checked, labels
    return checked, components(checked.filter("linked"))
