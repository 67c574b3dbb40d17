"""Words that stand together more often than chance, mined from an FM-index per shard.

Texts are cut into shards of word ids.  Each shard lists its phrases with
their counts from its own index and the counts are summed over shards.  Words
that are too rare over all shards leave the texts first, then pairs, then
triples; a shard gets back only which of *its* own stay.  No dictionary of
the corpus is sent anywhere, and a phrase below the bound in one shard is
never lost to the sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.blobs import spread
from tickloom.llm.fm_index import Phrases, WordIndex
from tickloom.llm.rows import sliced
from tickloom.session import new_folder, settle

SHARD_WORDS = 1_000_000     # words of one index: some 60 MB while it is sorted
BUCKET_BYTES = 32 << 20     # hashes of pairs that one task sums
UNKNOWN = "und"
# What ends a piece, and what parts its words.
ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"

_BREAK = b"\xff"            # no byte of UTF-8
_PLAIN = bytes(ord(_BREAK) if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SALTS = 64

SHARDS = "shard long, lang string, n long, ids binary, words array<string>, counts array<int>"
LISTED = "lang string, bucket int, phrases array<string>, counts array<long>"
SENT = "shard long, lang string, bucket int, packed binary, ids binary, words array<string>"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """Ids of the words read so far; 0 ends a piece or a text."""

    def __init__(self) -> None:
        self.numbers = _Numbers({_BREAK: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        words = _BREAK.join([*texts, b""]).translate(_PLAIN).replace(_BREAK, b" \xff ").split()
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        ids = ids[(ids > 0) | (np.r_[0, ids[:-1]] > 0)]
        self.parts.append(ids)
        self.size += len(ids)

    def row(self, shard: int, lang: str) -> dict:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.numbers))[1:]
        words = [w.decode() for w in list(self.numbers)[1:]]
        return {"shard": shard, "lang": lang, "n": int(counts.sum()), "ids": _packed(ids), "words": words, "counts": counts.tolist()}


_SHARD_ROWS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("ids", pa.binary()),
                         ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

_SENT_ROWS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("bucket", pa.int32()), ("packed", pa.binary()), ("ids", pa.binary()),
                        ("words", pa.list_(pa.string()))])


def _shards(shard_words: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}
        number = TaskContext.get().partitionId() << 32

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([open_.pop(lang).row(number, lang)], _SHARD_ROWS)

        for batch in sliced(batches):
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang)).cast(pa.binary()).to_pylist()
                shard = open_.setdefault(lang, _Shard())
                shard.add(texts)
                if shard.size >= shard_words:
                    yield close(lang)
        for lang in list(open_):
            yield close(lang)

    return made


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: lowest bytes first, the upper ones are mostly equal and pack well."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed.as_buffer()), np.uint8)
    return planes.reshape(4, -1).T.copy().view("<u4").ravel()


def _lists(back: pa.Scalar) -> list[np.ndarray]:
    """What was sent back to a shard."""
    return [np.frombuffer(p.as_buffer(), "<u8") for p in back.values] if back.is_valid else []


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}


def _usual(row: dict[str, pa.Scalar]) -> tuple[np.ndarray, pa.Array]:
    """The text of a shard in its frequent words alone, numbered anew, 0 wherever others stood."""
    usual = row["usual"].values
    ids = _unpacked(row["ids"])
    number = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
    number[usual.field("id").to_numpy()] = np.arange(1, len(usual) + 1)
    return number[ids], usual.field("phrase")


def _runs(ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """``ids`` cut wherever neighbours are not ``joined`` (one flag per gap), without words that stand alone then."""
    if not len(ids):
        return ids
    run = np.r_[0, np.cumsum(~joined)]
    long_ = np.bincount(run)[run] > 1
    ids, run = ids[long_], run[long_]
    out = np.zeros(len(ids) + int(run.max(initial=-1)) + 1, ids.dtype)
    out[np.arange(len(ids)) + run] = ids
    return out[(out > 0) | (np.r_[0, out[:-1]] > 0)]


def _triple_runs(ids: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The words of every run of ``heavy`` triples (one flag per start); a word that ends one run and starts the next is in both."""
    starts = np.flatnonzero(heavy)
    if not len(starts):
        return ids[:0]
    first = np.r_[True, np.diff(starts) > 1]
    begin, size = starts[first], np.diff(np.r_[np.flatnonzero(first), len(starts)]) + 3     # two words more and a break
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out = ids[np.minimum(at, len(ids) - 1)]
    out[np.cumsum(size) - 1] = 0
    return out


KEY_BITS = 24           # of a hash inside its bucket
_KEY = np.uint64((1 << KEY_BITS) - 1)


class _Keys:
    """Numbers of phrases that mean the same in every shard: a bucket and 32 bits of a hash inside it."""

    def __init__(self, lang: str, words: pa.Array, buckets: int) -> None:
        seed = xxhash.xxh64_intdigest(lang.encode())
        named = [0, *(xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist())]
        self.word, self.buckets = np.array(named, np.uint64), np.uint64(buckets)

    def of(self, first: np.ndarray, *others: np.ndarray) -> np.ndarray:
        mixed = self.word[first]
        for other in others:
            mixed = spread(mixed * np.uint64(0x9E3779B97F4A7C15) + self.word[other])
        low = np.uint64(32)
        return (((mixed >> low) * self.buckets) >> low << low) | (mixed & _KEY)

    def hints(self, shard: int, lang: str, found: Phrases, least: int) -> Iterator[pa.RecordBatch]:
        """Hashes of phrases in order, by bucket, with counts in the upper byte; counts end at what decides alone."""
        keys = self.of(*found.words.T)
        order = np.argsort(keys)
        keys = keys[order]
        values = (keys & _KEY).astype("<u4") | np.minimum(found.count[order], min(least, 255)).astype("<u4") << np.uint32(KEY_BITS)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(keys) else []
        rows = [{"shard": shard, "lang": lang, "bucket": int(bucket[a]), "packed": _packed(values[a:b])} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SENT_ROWS)


def _held(keys: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Which keys one of the lists holds."""
    return np.isin(keys, np.concatenate(lists)) if lists else np.zeros(len(keys), bool)


def _pairs(buckets: int, least: int):
    """The pairs of frequent words of each shard, as hashes."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _shard_rows(batches):
            text, words = _usual(row)
            (found,) = WordIndex(_runs(text, (text[:-1] > 0) & (text[1:] > 0)), 2).enumerate(2)
            yield from _Keys(row["lang"].as_py(), words, buckets).hints(row["shard"].as_py(), row["lang"].as_py(), found, least)

    return listed


def _triples(buckets: int, least: int):
    """The text of each shard cut to runs of heavy pairs, and its triples as hashes."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _shard_rows(batches):
            shard, lang = row["shard"].as_py(), row["lang"].as_py()
            text, words = _usual(row)
            joined = _held(_Keys(lang, words, buckets).of(text[:-1], text[1:]), _lists(row["back"])) & (text[:-1] > 0) & (text[1:] > 0)
            used, text = np.unique(np.r_[0, _runs(text, joined)], return_inverse=True)
            text, words = text[1:].astype(np.int32), words.take(pa.array(used[1:] - 1))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "lang": lang, "ids": _packed(text), "words": words.to_pylist()}], _SENT_ROWS)
            *_, found = WordIndex(text, 3).enumerate(3)
            yield from _Keys(lang, words, buckets).hints(shard, lang, found, least)

    return listed


def _heavy(least: int):
    """Of one bucket: the hashes that may belong to a frequent phrase, for each shard that sent them."""

    def found(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sent = [_unpacked(p) for p in rows.column("packed")]
        every = np.concatenate(sent)
        keys, place = np.unique(every & np.uint32(_KEY), return_inverse=True)
        kept = np.bincount(place, every >> np.uint32(KEY_BITS)) >= min(least, 255)
        at, top = np.cumsum([0, *map(len, sent)]), np.uint64(key[0].as_py()) << np.uint64(32)
        mine = [keys[place[a:b][kept[place[a:b]]]].astype("<u8") | top for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"shard": rows.column("shard"), "packed": pa.array([m.tobytes() for m in mine])})

    return found


def _phrases(buckets: int, longest: int):
    """Every phrase of a shard whose pairs and triples may all be frequent, with its count, by bucket."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _shard_rows(batches):
            lang, ids, words = row["lang"].as_py(), _unpacked(row["ids"]).astype(np.int32), row["words"].values
            keys = _Keys(lang, words, buckets)
            there = (ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)
            heavy = _held(keys.of(ids[:-2], ids[1:-1], ids[2:]), _lists(row["back"])) & there
            pairs = list(WordIndex(ids, 2).enumerate(2))
            longer = list(WordIndex(_triple_runs(ids, heavy), longest).enumerate(longest))[1:]
            for found in pairs + longer:
                bucket = (keys.of(*found.words.T) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                spelled = pc.binary_join_element_wise(*[words.take(pa.array(column - 1)) for column in found.words[order].T], " ")
                cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True]) if len(order) else [0]
                offsets = pa.array(np.asarray(cuts, np.int32))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * (len(cuts) - 1), pa.string()), "bucket": pa.array(bucket[order][cuts[:-1]], pa.int32()),
                    "phrases": pa.ListArray.from_arrays(offsets, spelled), "counts": pa.ListArray.from_arrays(offsets, pa.array(found.count[order], pa.int64())),
                })

    return listed


def _added(least: int):
    """Sums of one bucket of one lang, phrase by phrase as they are spelled."""

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        flat = pa.table({"phrase": pc.list_flatten(rows.column("phrases")), "a": pc.list_flatten(rows.column("counts"))})
        sums = flat.group_by("phrase").aggregate([("a", "sum")])
        kept = sums.filter(pc.greater_equal(sums.column("a_sum"), least))
        return pa.table({"lang": pa.array([key[0].as_py()] * kept.num_rows, pa.string()), "phrase": kept.column("phrase"), "a": kept.column("a_sum")})

    return add


def _with(shards: DataFrame, sent: DataFrame, how: str = "inner") -> DataFrame:
    """Shards with the lists that are sent back to them; these grow with the corpus, so neither side is told to all."""
    return shards.join(sent.groupBy("shard").agg(F.collect_list("packed").alias("back")).hint("merge"), "shard", how)


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of 1 to ``longest`` words with at least ``least`` occurrences, and (lang, n).

    A phrase is frequent only if its words, pairs and triples are.  Words are
    summed first; then pairs and triples as hashes, whose sums are never below
    those of the phrases themselves; what is left is summed as it is.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    path = new_folder(spark, "shards")
    read.mapInArrow(_shards(shard_words), SHARDS).write.option("compression", "zstd").parquet(path)
    shards = spark.read.schema(SHARDS).parquet(path)
    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "word"))
    words = words.select("shard", "lang", F.col("word.words").alias("phrase"), (F.col("at") + 1).alias("id"), F.col("word.counts").alias("count"))
    total_of = F.sum("count").over(Window.partitionBy("lang", "phrase"))
    stays = settle(words.withColumn("a", total_of).filter(F.col("a") >= least).drop("count"))     # each word beside its total: nothing to join
    singles = stays.groupBy("lang", "phrase").agg(F.first("a").alias("a"))
    total = shards.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 4 // BUCKET_BYTES))

    def heavy(sent: DataFrame) -> DataFrame:
        return sent.select("shard", "bucket", "packed").groupBy("bucket").applyInArrow(_heavy(least), "shard long, packed binary")

    usual = stays.groupBy("shard").agg(F.collect_list(F.struct("id", "phrase")).alias("usual")).hint("merge")
    texts = shards.select("shard", "lang", "ids").join(usual, "shard")
    pairs = heavy(texts.mapInArrow(_pairs(buckets, least), SENT))
    sent = settle(_with(texts, pairs).mapInArrow(_triples(buckets, least), SENT))
    triples = heavy(sent.filter("bucket is not null"))
    found = _with(sent.filter("bucket is null").select("shard", "lang", "ids", "words"), triples, "left").mapInArrow(_phrases(buckets, longest), LISTED)
    counts = found.groupBy("lang", "bucket").applyInArrow(_added(least), "lang string, phrase string, a long")
    return settle(singles.unionByName(counts)), shards.groupBy("lang").agg(F.sum("n").alias("n"))


def _words(phrase: str) -> Column:
    return F.split(phrase, " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The ``top`` phrases of each lang by their weakest cut, with ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of ``a`` occurrences cut into parts of ``l`` and ``r`` scores
    floor(1000 * a * n / (l * r)); products are decimals of 38 digits.  A
    phrase that always stands inside one longer phrase gives way to it: such a
    longer phrase has an equal count, and so has the one between them that is
    a single word longer, so only those are looked at.

    Null texts are empty, null langs count as ``und``; empty tables give no
    rows; copies of a row count as often as they occur; ties go by the phrase
    in byte order; other columns are ignored.  A lang spread over many shards
    is ranked in salted parts first.
    """
    counts, sizes = phrase_counts(docs, text, lang, least, longest, shard_words)
    found = counts.withColumn("size", F.size(_words("phrase")))
    candidates = found.filter("size > 1")
    part = counts.select("lang", F.col("phrase").alias("_part"), F.col("a").alias("_f"))
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.selectExpr("*", "substring_index(phrase, ' ', k) as _l", "substring_index(phrase, ' ', k - size) as _r")
    for side, name in (("_l", "l"), ("_r", "r")):
        cut = cut.join(part.select("lang", F.col("_part").alias(side), F.col("_f").alias(name)), ["lang", side]).drop(side)
    scored = (
        cut.join(sizes, "lang")
        .selectExpr("*", "(1000BD * cast(a as decimal(18,0)) * n) div (cast(l as decimal(19,0)) * r) as score")
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("cut"))
        .select("lang", "phrase", "cut.*")
    )
    wider = candidates.filter("size > 2")
    inner = "array(substring_index(phrase, ' ', size - 1), substring_index(phrase, ' ', 1 - size))"
    covered = wider.selectExpr("lang", f"explode({inner}) as phrase", "a").distinct()
    kept = scored.join(covered, ["lang", "phrase", "a"], "left_anti")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    kept = kept.withColumn("_place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).filter(F.col("_place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
