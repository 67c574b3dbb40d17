import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row_id", T.StringType()),
    T.StructField("ids", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("_row", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("rank", T.LongType()),
])


def awkward_texts():
    """Nulls, empty and one-word texts, copies, near copies, shared passages, a long and an unsplit text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(120), prose(300)
    near = []
    for _ in range(12):
        words = base.split()
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = word()
        near.append(" ".join(words))
    shared = [f"{prose(rng.randint(1, 40))} {passage} {prose(rng.randint(1, 40))}" for _ in range(9)]
    tiny = ["a", "a", "A", "a b c d", "a b c d", "a b c d e", "a b c d e f", "  \n\t ", "", None, None, "a b c d e f g h i"]
    lines = ["x\ny\nz\nx\ny\nz", "q\nx\ny\nz", "x\ny", "\n\n\n\n"]
    return [*tiny, *lines, base, base, base.upper(), *near, *shared, passage, prose(9000), "ab" * 9000, "é" * 500, prose(200) + " " + "z" * 900 + prose(30)]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    texts = awkward_texts()
    ids = [None if i % 17 == 5 else i // 2 if i % 11 == 3 else i for i in range(len(texts))]
    rows = [(d, t, "x", 1, "y", "z", 2, 3, 4) for d, t in zip(ids, texts, strict=True)]
    rows += [rows[13], rows[13]]
    path = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def pairs(awkward):
    return [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("doc_id < -5")
