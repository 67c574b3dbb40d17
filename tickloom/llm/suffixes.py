"""Removal of long byte strings that occur more than once anywhere in a table.

A start is repeated if the ``length`` bytes from it on also start elsewhere.

*Blocks.*  Each start has an anchor, the place in its string whose short hash is
smallest; equal strings have it at the same distance.  Neighbouring starts with
the same anchor form blocks of at most ``SPAN`` starts, which share a core of
``length - SPAN + 1`` bytes.  Strings can only be equal if their cores are, so
blocks meet by a hash of the core.  Blocks whose whole surroundings are equal
are repeated from the first start to the last.

*Suffix arrays.*  Where surroundings differ, every one of them becomes a string
of symbols, bytes on both sides and the core as one symbol, and the suffixes of
all strings that share a core are sorted by linear grouping construction.
Suffixes that agree on ``SPAN`` symbols lie side by side, and their starts are
repeated.  Cores that very many surroundings share are dealt out start by start.

*Passages.*  Repeats counted in words are found by the same two steps over texts
in which every word is a code of ``CODE`` bytes and strings start at words only
(``step``); see ``drop_passages``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import blobs
from tickloom.llm.grouping_sort import suffix_array
from tickloom.llm.rows import free_name, numbered, numbered_whole, sliced
from tickloom.llm.shingles import in_portions
from tickloom.session import settle

LENGTH = 400
SPAN = 64
GRAM = 16                   # bytes that decide on an anchor
REMEMBERED = 1_000_000      # blocks a task recognises again
MOST_TOGETHER = 20_000      # surroundings of a core that are sorted in one task
PASSAGES_TOGETHER = 4_000   # the same where texts are looked through twice, by words and by bytes
WORDS = 51                  # words of a passage that is cut wherever it occurs twice
CODE = 8                    # bytes that stand for a word
CODES = 250_000             # codes a task remembers

RECORD = np.dtype([("core", "<u4"), ("whole", "<u8"), ("row", "<i8"), ("at", "<i8"), ("lead", "u1"), ("n", "u1")])
RUN = np.dtype([("row", "<i8"), ("at", "<i8"), ("n", "<i8")])

_LETTERS = np.random.default_rng(77).integers(1, 1 << 63, 256, "u8") | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def _powers(size: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < size:
        for k, base in enumerate((_STEP, _BACK)):
            factors = np.full(size, base, "u8")
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS


class RangeHash:
    """Hash of any range of a byte string from one pass over it."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, "u8")
        np.cumsum(_LETTERS[raw] * up[: len(raw)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return blobs.spread((self.sums[end] - self.sums[begin]) * self.down[begin])


def sliding_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from prefix and suffix minima of blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo("u8").max, "u8")
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1:n])


def blocks_of(texts: list[bytes], length: int = LENGTH, step: int = 1) -> tuple[np.ndarray, ...] | None:
    """Blocks of all texts: text, first start in it, bytes with starts, bytes before the core begins, hash of core, hash of surroundings.

    Strings start at every ``step``-th byte; texts, ``length``, ``SPAN`` and ``GRAM`` are whole steps.
    """
    raw = np.frombuffer(b"".join(texts), "u1")
    if len(raw) < length:
        return None
    sizes = np.array([len(t) for t in texts])
    bounds = np.cumsum(np.r_[0, sizes])
    hashed = RangeHash(raw)
    place = np.arange(0, len(raw) - GRAM + 1, step)
    grams = hashed(place, place + GRAM)
    marked = (grams & np.uint64(0xFFFFFFFF00000000)) | place.astype("u8")      # leftmost of equal ones
    anchor = (sliding_smallest(marked, (length - GRAM) // step + 1) & np.uint64(0xFFFFFFFF)).astype("i8")
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return None
    counts = (sizes[long] - length) // step + 1
    nth_start = np.arange(int(counts.sum())) + np.repeat(bounds[long] // step - (np.cumsum(counts) - counts), counts)
    starts, anchor = nth_start * step, anchor[nth_start]
    text = np.repeat(long, counts)
    nth = (anchor - starts) // SPAN         # block before the anchor
    core = anchor - nth * SPAN              # where the core of the block begins
    new = np.r_[True, (core[1:] != core[:-1]) | (nth[1:] != nth[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(starts)]) * step
    begin, core, nth, text = starts[at], core[at], nth[at], text[at]
    core_hash = blobs.spread(hashed(core, core + length - SPAN + step) + nth.astype("u8"))
    lead = core - begin
    shape = (lead * 256 + n).astype("u8")
    whole = blobs.spread(hashed(begin, begin + n - step + length) ^ blobs.spread(shape) ^ core_hash)
    return text, begin - bounds[text], n, lead, core_hash, whole


def merged(row: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of starts, with runs that touch in the same row made one."""
    order = np.lexsort((at, row))
    row, at, n = row[order], at[order], n[order]
    if not len(row):
        return np.zeros(0, RUN)
    new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + n[:-1])]
    first = np.flatnonzero(new)
    out = np.zeros(len(first), RUN)
    out["row"], out["at"] = row[first], at[first]
    out["n"] = np.maximum.reduceat(at + n, first) - at[first]
    return out


SENT = "bucket int, packed binary, runs binary"
FOUND = "row_id long, at long, n long, core long, lead int, sure boolean"


def meet_blocks(texts: DataFrame, buckets: int, length: int, step: int = 1) -> DataFrame:
    """Written table: runs of repeated starts (no core), and blocks still open with the core they share."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[bytes, int] = {}
        times: dict[int, int] = {}
        for batch in batches:
            rows = batch.column("row_id").to_numpy()
            for first, portion in in_portions(batch.column("text").to_pylist()):
                own = rows[first:first + len(portion)]
                runs: list[tuple[int, int, int]] = []
                fresh = []
                for i, raw in enumerate(portion):
                    if len(raw) < length:
                        continue
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    copies[digest] = seen = copies.get(digest, 0) + 1
                    if seen <= 2:       # a third copy is known to be one; two are enough for the others
                        fresh.append(i)
                    else:
                        runs.append((int(own[i]), 0, len(raw) - length + step))
                if len(copies) + len(times) > REMEMBERED:
                    copies.clear()
                    times.clear()
                found = blocks_of([portion[i] for i in fresh], length, step) if fresh else None
                dealt: list[tuple[int, bytes]] = []
                if found:
                    text, at, n, lead, core, whole = found
                    row = own[np.array(fresh)][text]
                    sent = np.ones(len(core), bool)
                    for i, key in enumerate((core ^ (whole << np.uint64(1))).tolist()):
                        times[key] = seen = times.get(key, 0) + 1
                        sent[i] = seen <= 2
                    runs += zip(row[~sent].tolist(), at[~sent].tolist(), n[~sent].tolist(), strict=True)
                    records = np.zeros(int(sent.sum()), RECORD)
                    for name, values in (("core", core.astype("u4")), ("whole", whole), ("row", row), ("at", at), ("lead", lead), ("n", n)):
                        records[name] = values[sent]
                    dealt = blobs.deal(records, ((core >> np.uint64(32)) % np.uint64(buckets)).astype("i4")[sent])
                packed = merged(*np.array(runs, "i8").reshape(-1, 3).T).tobytes() if runs else None
                out = [(b, p, None) for b, p in dealt] + ([(int(own[0]) % buckets, None, packed)] if packed else [])
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                        ["bucket", "packed", "runs"],
                    )

    def match(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        runs = np.frombuffer(b"".join(table.column("runs").drop_null().to_pylist()), RUN)
        records = blobs.unpack(table.filter(pc.is_valid(table.column("packed"))), RECORD)
        records = records[np.lexsort((records["whole"], records["core"]))]
        core, whole = records["core"], records["whole"]
        if len(records):
            new_core = np.r_[True, core[1:] != core[:-1]]
            new = new_core | np.r_[True, whole[1:] != whole[:-1]]
            first = np.flatnonzero(new)
            copies = np.repeat(np.diff(np.r_[first, len(core)]), np.diff(np.r_[first, len(core)]))
            of_core = np.cumsum(new_core) - 1
            kinds = np.bincount(of_core, weights=new)[of_core]
            sure = copies > 1
            open_ = new & (kinds > 1)       # one block of each kind, where there are several
        else:
            sure = open_ = np.zeros(0, bool)
        whole_runs = merged(*[np.r_[records[f][sure], runs[f]].astype("i8") for f in ("row", "at", "n")])
        left = records[open_]
        k, m = len(whole_runs), len(left)
        key = ((np.uint64(bucket) << np.uint64(32)) | left["core"].astype("u8")).astype("i8")
        return pa.table({
            "row_id": np.r_[whole_runs["row"], left["row"]], "at": np.r_[whole_runs["at"], left["at"]], "n": np.r_[whole_runs["n"], left["n"].astype("i8")],
            "core": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(key)]),
            "lead": pa.array(np.r_[np.zeros(k, "i4"), left["lead"].astype("i4")]), "sure": np.r_[np.ones(k, bool), sure[open_]],
        })

    return settle(texts.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(match, FOUND))


SIDES = "core long, row_id long, at long, lead int, sure boolean, middle binary, left binary, right binary"


def surroundings(texts: DataFrame, open_: DataFrame, length: int, step: int = 1) -> DataFrame:
    """The bytes around the core of every open block; the core itself as a 128-bit digest."""
    wanted = open_.groupBy("row_id").agg(F.collect_list(F.struct("at", "n", "core", "lead", "sure")).alias("blocks"))     # a row's own

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core_size = length - SPAN + step
        for batch in batches:
            for i in range(batch.num_rows):
                row, raw = batch.column("row_id")[i].as_py(), (batch.column("text")[i].as_py() or "").encode()
                out = []
                for b in batch.column("blocks")[i].as_py():
                    at, n, lead = b["at"], b["n"], b["lead"]
                    core, end = at + lead, at + n - step + length
                    middle = hashlib.blake2b(raw[core:core + core_size], digest_size=16).digest()
                    out.append((b["core"], row, at, lead, b["sure"], middle, raw[at:core], raw[core + core_size:end]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in SIDES.split(", ")])

    return texts.join(wanted, "row_id").select("row_id", "text", "blocks").mapInArrow(cut, SIDES)


def repeated_starts(middles: list[bytes], lefts: list[bytes], rights: list[bytes], step: int = 1) -> list[np.ndarray]:
    """For each string (left, core, right) the offsets in it from which ``SPAN`` bytes also occur in another one.

    A symbol is ``step`` bytes, or a core, which counts as ``step`` bytes too.
    """
    symbol: dict[bytes, int] = {}       # cores, and words if a symbol is more than a byte; a core's digest has another size
    count = len(lefts)
    span = SPAN // step

    def side(raw: bytes) -> list[int]:
        if step == 1:
            return [b + count for b in raw]
        return [count + 256 + symbol.setdefault(raw[i:i + step], len(symbol)) for i in range(0, len(raw), step)]

    symbols: list[int] = []
    begins = []
    for k in range(count):
        begins.append(len(symbols))
        symbols += side(lefts[k])
        symbols.append(count + 256 + symbol.setdefault(middles[k], len(symbol)))
        symbols += side(rights[k])
        symbols.append(count - 1 - k)       # ends differ; the last one is the smallest
    order = np.array(suffix_array(symbols))
    owner = np.zeros(len(symbols), "i4")
    owner[begins[1:]] = 1
    owner = np.cumsum(owner)
    offset = np.arange(len(symbols)) - np.array(begins)[owner]
    size = np.array([(len(a) + len(b)) // step + 1 for a, b in zip(lefts, rights, strict=True)])
    before = np.array([len(a) // step for a in lefts])
    starts = (offset[order] <= before[owner[order]]) & (offset[order] + span <= size[owner[order]])
    order = order[starts]
    text = "".join(map(chr, symbols)) if max(symbols, default=0) < 0xD800 else symbols
    same = np.array([text[a:a + span] == text[b:b + span] for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)], bool)
    hit = order[np.r_[same, False] | np.r_[False, same]] if len(order) > 1 else order[:0]
    out: list[list[int]] = [[] for _ in range(count)]
    for i in hit.tolist():
        out[owner[i]].append(int(offset[i]) * step)
    return [np.array(sorted(x), "i8") for x in out]


def sort_groups(sides: DataFrame, buckets: int, step: int = 1) -> DataFrame:
    """Runs of repeated starts from the suffix arrays of all cores: row_id, at, n."""

    def solve(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("core", "row_id", "at", "sure", "middle", "left", "right")}
        order = sorted(range(table.num_rows), key=columns["core"].__getitem__)
        runs: list[tuple[int, int, int]] = []
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and columns["core"][order[j]] == columns["core"][order[i]]:
                j += 1
            own = order[i:j]
            found = repeated_starts(*[[columns[c][k] for k in own] for c in ("middle", "left", "right")], step)
            for k, offsets in zip(own, found, strict=True):
                if not columns["sure"][k]:
                    runs += [(columns["row_id"][k], columns["at"][k] + o, step) for o in offsets.tolist()]
            i = j
        return _runs_table(runs)

    dealt = sides.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(solve, "row_id long, at long, n long")


def _runs_table(runs: list[tuple[int, int, int]]) -> pa.Table:
    found = merged(*np.array(runs, "i8").reshape(-1, 3).T)
    return pa.table({"row_id": found["row"], "at": found["at"], "n": found["n"]})


def split_starts(sides: DataFrame, step: int = 1) -> DataFrame:
    """The same for cores that very many blocks share: starts meet one by one, by a digest of their whole string."""
    offset = F.explode(F.sequence(F.lit(0), F.length("left") + F.length("right") + step - SPAN, F.lit(step))).alias("o")
    each = sides.select("*", offset)
    head = F.substring("left", F.col("o") + 1, F.lit(SPAN))
    tail = F.substring("right", F.lit(1), F.col("o") + SPAN - step - F.length("left"))
    keyed = each.select("row_id", "at", "o", "sure", F.sha2(F.concat(head, F.lit("|").cast("binary"), "middle", F.lit("|").cast("binary"), tail), 256).alias("key"), (F.length("left") - F.col("o")).alias("before"))
    often = keyed.groupBy("key", "before").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return keyed.filter("not sure").join(often, ["key", "before"]).select("row_id", (F.col("at") + F.col("o")).alias("at"), F.lit(step).cast("long").alias("n"))


def repeated_runs(texts: DataFrame, length: int = LENGTH, most_together: int = MOST_TOGETHER, step: int = 1) -> DataFrame:
    """row_id, runs: for every row with repeated starts, where they are (first start, bytes from it on with a start every ``step``)."""
    buckets = blobs.bucket_count(texts.sparkSession)
    found = meet_blocks(texts, buckets, length, step)
    open_ = found.filter("core is not null")
    large = settle(open_.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most_together).select("core"))
    sides = settle(surroundings(texts, open_, length, step))
    runs = found.filter("core is null").select("row_id", "at", "n")
    if large.isEmpty():
        runs = runs.union(settle(sort_groups(sides, buckets, step)))
    else:
        runs = runs.union(settle(sort_groups(sides.join(large, "core", "left_anti"), buckets, step))).union(split_starts(sides.join(large, "core", "left_semi"), step))
    return runs.groupBy("row_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))        # a row's own


def covered(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of a text."""
    out: list[tuple[int, int]] = []
    for at, n in sorted((r["at"], r["n"]) for r in runs or []):
        end = at + n - 1 + length
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at, end))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


REMOVED = (
    "row_id long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, "
    "n_passages long, text_without_passages string"
)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
    most_together: int = MOST_TOGETHER, words: int = WORDS,
) -> DataFrame:
    """row_id, doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_passages, text_without_passages for every row of ``docs``.

    ``text`` is what is left; a character that loses a byte goes as a whole.
    ``n_passages`` counts what the bytes do not bound, the maximal runs of words
    covered by passages of ``words`` words that occur more than once, and
    ``text_without_passages`` is what is left without these too, as from
    ``drop_passages``.

    Texts are taken as UTF-8 bytes, null as empty; texts shorter than
    ``length`` keep all bytes; strings never cross rows; rows with null or
    repeated ids are texts of their own, and an empty table gives no row.
    """
    texts = numbered(docs, doc_id=id_column, text=text_column)
    runs = passage_runs(texts, words, length, most_together)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                raw = text.encode()
                spans = covered(batch.column("runs")[i].as_py(), length)
                rest = without(raw, spans)
                left = rest.decode(errors="ignore")
                word_runs = batch.column("word_runs")[i].as_py()
                passages = joined(passage_spans(text, word_runs, words)) if word_runs else []
                left_without = without(raw, joined(spans + passages)).decode(errors="ignore") if passages else left
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest(), left, len(passages), left_without))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]],
                [f.split()[0] for f in REMOVED.split(", ")],
            )

    return texts.join(runs, "row_id", "left").select("row_id", "doc_id", "text", "runs", "word_runs").mapInArrow(cut, REMOVED)


def drop_repeats(docs: DataFrame, length: int = LENGTH, text_column: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of the text; a character that loses a byte goes as a whole.

    A null text stays null; other columns stay as they were.
    """
    whole, row = numbered_whole(docs)
    found = free_name(whole, "_runs")
    runs = repeated_runs(numbered(docs, text=text_column), length).withColumnsRenamed({"row_id": row, "runs": found})

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array(
            [t if not r else without(t.encode(), covered(r, length)).decode(errors="ignore") for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True)],
            pa.string(),
        )

    stays = {text_column: cut(F.col(f"`{text_column}`"), F.col(found)).alias(text_column)}
    return whole.join(runs, row, "left").select(*[stays.get(c, F.col(f"`{c}`")) for c in docs.columns])


# --- passages counted in words ------------------------------------------------------------------

_WORD = re.compile(r"\w+(?:[^\w\s]+\w+)*")      # no space inside, a letter or digit at both ends


_OTHERS = bytes(0x20 + b % 64 for b in range(256))     # places of a code but the first


class WordCodes(dict):
    """Code of a word: ``CODE`` characters of its hash, the first from letters that no other place has, so words stay aligned."""

    def __missing__(self, word: str) -> str:
        if len(self) >= CODES:
            self.clear()
        hashed = hashlib.blake2b(word.encode(), digest_size=CODE).digest()
        self[word] = code = chr(0x60 + hashed[0] % 32) + hashed[1:].translate(_OTHERS).decode()
        return code


def coded(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``row_id`` and the codes of all words in a row; rows with fewer than ``words`` words are left out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in sliced(batches):
            rows, out = [], []
            for row, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = _WORD.findall(text or "")
                if len(found) >= words:
                    rows.append(row)
                    out.append("".join([codes[w] for w in found]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.string())], ["row_id", "text"])

    return texts.mapInArrow(encode, "row_id long, text string")


def passage_spans(text: str, runs: list[dict], words: int = WORDS) -> list[tuple[int, int]]:
    """Byte ranges of the passages, from the runs of starts in the codes of the text."""
    places = np.array([m.span() for m in _WORD.finditer(text)]).reshape(-1, 2)
    if not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        places = np.r_[0, np.cumsum(sizes)][places]
    out = []
    for at, n in ((r["at"], r["n"]) for r in runs):
        first, last = -(-at // CODE), (at + n - 1) // CODE
        if first <= last:
            out.append((int(places[first, 0]), int(places[last + words - 1, 1])))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that meet made one."""
    out: list[tuple[int, int]] = []
    for at, end in sorted(spans):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at, end))
    return out


def passage_runs(texts: DataFrame, words: int, length: int, most_together: int) -> DataFrame:
    """row_id, runs, word_runs: where ``length`` bytes start that repeat, and where ``words`` words do, in the codes of a row."""
    none = F.lit(None).cast("array<struct<at:bigint,n:bigint>>")
    by_bytes = repeated_runs(texts, length, most_together).select("row_id", "runs", none.alias("word_runs"))
    by_words = repeated_runs(settle(coded(texts, words)), words * CODE, most_together, CODE).select("row_id", none.alias("runs"), F.col("runs").alias("word_runs"))
    return by_bytes.union(by_words).groupBy("row_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("runs", "word_runs")])


def drop_passages(
    docs: DataFrame, words: int = WORDS, length: int = LENGTH, text_column: str = "text", most_together: int = PASSAGES_TOGETHER
) -> DataFrame:
    """``docs`` without any passage of ``words`` words, or of ``length`` bytes, that occurs more than once.

    A word holds no space and has a letter or digit at both ends; passages are
    equal if their words are, whatever stands between them.  All occurrences go,
    from the first letter of the first word to the last one of the last word.
    ``length`` bytes that repeat go as in ``drop_repeats``, which covers texts
    that are not written with spaces.  Both are looked for in the texts as they
    come in.  A null text stays null, and an empty table gives no row.
    """
    whole, row = numbered_whole(docs)
    found, in_words = free_name(whole, "_runs"), free_name(whole, "_word_runs")
    runs = passage_runs(numbered(docs, text=text_column), words, length, most_together).withColumnsRenamed({"row_id": row, "runs": found, "word_runs": in_words})

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array, word_runs: pa.Array) -> pa.Array:
        out = []
        for t, r, w in zip(texts.to_pylist(), runs.to_pylist(), word_runs.to_pylist(), strict=True):
            spans = joined(covered(r, length) + passage_spans(t, w, words)) if w else covered(r, length)
            out.append(without(t.encode(), spans).decode(errors="ignore") if spans else t)
        return pa.array(out, pa.string())

    stays = {text_column: cut(F.col(f"`{text_column}`"), F.col(found), F.col(in_words)).alias(text_column)}
    return whole.join(runs, row, "left").select(*[stays.get(c, F.col(f"`{c}`")) for c in docs.columns])
