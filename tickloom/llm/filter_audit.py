"""What each filter removes, depending on which filters ran before it.

Failing documents go into posting lists: per part of the table, range of ids
and filter, the sorted ids that fail it.  A task holds the lists of one range,
merges them for every set of earlier filters and gives sizes, which add up over
ranges.  Orders of filters are read off those sizes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.posting_lists import common, difference, union
from tickloom.llm.rows import numbered
from tickloom.session import settle

RANGE_ROWS = 65_536     # rows of one range of ids on average
_SALTS = 64

SIZES = "part string, filter string, before int, failing long, removed long, gone long, good_lost long, toxic_lost long"

Filter = tuple[str, Callable[[Column], Column]]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


# The four filters of a text by itself; each says when it fails.
TEXT_FILTERS: tuple[Filter, ...] = (
    ("A", lambda text: F.size(_words(text)) < 200),
    ("B", lambda text: 100 * F.size(F.array_distinct(_words(text))) < 50 * F.size(_words(text))),
    ("C", lambda text: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text)),
    ("D", lambda text: text.rlike("[#$%&*|]")),
)
REPEATED = "E"          # a row with a smaller id has the same text


def _copies(rows: DataFrame) -> DataFrame:
    """``row_id`` of rows whose text some smaller id has; copies of a text are dealt to salts on the way."""
    salted = rows.withColumn("_salt", F.pmod("row_id", F.lit(_SALTS)))
    parts = salted.groupBy("digest", "_salt").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    texts = parts.groupBy("digest").agg(F.min("_least").alias("first"), F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts"))
    firsts = texts.filter("_n > 1").select("digest", "first", F.explode("_salts").alias("_salt"))
    return salted.join(firsts, ["digest", "_salt"]).filter(F.col("id") > F.col("first")).select("row_id")


def failures(
    docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang", id: str = "doc_id",
    filters: Sequence[Filter] = TEXT_FILTERS,
) -> DataFrame:
    """Per row ``row_id, part, failing`` (one bit per filter, the last for repeated texts), ``good, toxic``.

    Texts are compared by their SHA-256.  Rows of ``labels`` with one id are
    taken together: one of them suffices to mark a document.
    """
    content = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(fails(content), 1 << i).otherwise(0) for i, (_, fails) in enumerate(filters)]
    rows = numbered(docs, text=text, part=part, id=id).select(
        "row_id", "id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(content, 256)).alias("digest"), sum(bits, F.lit(0)).alias("alone"),
    )
    rows = settle(rows)
    marks = labels.groupBy(F.col(f"`{id}`").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    again = _copies(rows).withColumn("again", F.lit(1 << len(filters)))
    return rows.join(marks, "id", "left").join(again, "row_id", "left").select(
        "row_id", "part", (F.col("alone") + F.coalesce("again", F.lit(0))).alias("failing"),
        (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"),
    )


def _merged(names: Sequence[str]) -> Callable[[tuple, pa.Table], pa.Table]:
    """Sizes of what each filter removes after each set of others, within one range of ids."""
    everything = (1 << len(names)) - 1

    def sizes(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_id")
        ids, failing = rows.column("row_id").to_pylist(), rows.column("failing").to_pylist()
        posted = [[i for i, bits in zip(ids, failing, strict=True) if bits >> f & 1] for f in range(len(names))]
        good, toxic = ([i for i, mark in zip(ids, rows.column(c).to_pylist(), strict=True) if mark] for c in ("good", "toxic"))
        united = {s: union([posted[f] for f in range(len(names)) if s >> f & 1]) for s in range(everything + 1)}
        out = []
        for f, name in enumerate(names):
            for before in range(everything + 1):
                if not before >> f & 1:
                    removed = difference(posted[f], united[before])
                    out.append((key[0].as_py(), name, before, len(posted[f]), len(removed), len(united[before | 1 << f]),
                                common(removed, good), common(removed, toxic)))
        columns = zip(*out, strict=True)
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SIZES.split(", ")])

    return sizes


def merged_sizes(rows: DataFrame, names: Sequence[str], total: int) -> DataFrame:
    """Per part, filter and set of earlier filters (one bit each): sizes summed over the ranges of ids."""
    ranges = max(1, -(-total // RANGE_ROWS))
    place = F.shiftright(F.shiftrightunsigned("row_id", 40) * ranges, 24)     # row ids are spread evenly over 64 bits
    posted = rows.filter("failing > 0").withColumn("range", place.cast("int"))
    sizes = posted.groupBy("part", "range").applyInArrow(_merged(names), SIZES)
    numbers = [c.split()[0] for c in SIZES.split(", ")][3:]
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in numbers])


def _orders(names: Sequence[str]) -> Column:
    """Every order of the filters, step by step."""
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "filter": name, "before": sum(1 << names.index(n) for n in order[:i])}
        for order in permutations(names) for i, name in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,before:int>>")


def audit(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, for rows as :func:`failures` gives them.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing, but
    removed earlier), ``unique_fails`` (failing this filter only),
    ``good_lost, toxic_lost`` among the removed, ``shapley`` (removed by the
    filter, summed over all orders).  A part whose rows all pass has zeros; an
    empty table gives no rows.  All orders are listed, so the result has
    factorial(filters) * filters rows a part.
    """
    rows = settle(rows)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    sizes = settle(merged_sizes(rows, names, rows.count()))
    before = F.bit_count("before")
    orders_with = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), before + 1)
    alone = F.when(before == len(names) - 1, F.col("removed"))
    whole = sizes.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders_with).alias("shapley"), F.max(alone).alias("unique_fails"))
    steps = parts.select("part", "rows", F.inline(_orders(names)))
    found = steps.join(sizes, ["part", "filter", "before"], "left").join(whole, ["part", "filter"], "left")
    value = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in (*[c.split()[0] for c in SIZES.split(", ")][3:], "shapley", "unique_fails")}
    return found.select(
        "part", "filter_order", "step", (F.col("rows") - value["gone"]).alias("kept"), value["removed"].alias("removed"),
        (value["failing"] - value["removed"]).alias("redundant"), value["unique_fails"].alias("unique_fails"),
        value["good_lost"].alias("good_lost"), value["toxic_lost"].alias("toxic_lost"), value["shapley"].alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang", id: str = "doc_id") -> DataFrame:
    """The audit of the five filters over whole texts.

    Null texts are empty, null parts the empty string; a null id is never
    larger than another, nor labelled; rows with one id and text are no copies
    of each other; other columns are ignored.
    """
    names = [name for name, _ in TEXT_FILTERS] + [REPEATED]
    return audit(failures(docs, labels, text, part, id), names)
