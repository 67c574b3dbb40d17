"""Exact deduplication as a stateful stream.

Digests flow through a keyed streaming aggregation whose state lies on disk
(RocksDB) and never expires: for each digest it retains the stable id to keep,
where that row's content is stored, and a count.  The state is then read back
as a table.  Rows that hit a digest held by another row are compared with the
content at the locator byte for byte, so a digest collision cannot drop a row.

Only DataFrame operations run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.rows import numbered, without_rows
from tickloom.session import new_folder, settle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_BATCH = 4096      # digest files that one micro-batch takes in
SALT_ROWS = 256             # copies compared with one replica of the kept text


def keyed_state(spark: SparkSession, landed: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Runs the digests landed in a folder through the keyed state and reads the state: digest, held, n."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")       # one open store a task, not one a partition
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint = new_folder(spark, "state")
    digests = (
        session.readStream.schema(spark.read.parquet(landed).schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landed)
    )
    held = digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("held"), F.count(F.lit(1)).alias("n"))
    query = (
        held.writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.format("statestore").load(checkpoint).select(
        "key.digest", F.col("value.max").alias("held"), F.col("value.count").alias("n")
    )


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Column | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is an empty one.  Of
    equal texts the row with the largest id stays (nulls are smallest; among
    rows with the same id exactly one stays, chosen by where it is stored).
    An empty table gives an empty result; other columns are not looked at.
    ``digest`` (over column ``text``) replaces SHA-256 as the key of the state.
    """
    spark = docs.sparkSession
    texts = numbered(docs, doc_id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    sha = F.sha2(F.col("text"), 256)
    landed = new_folder(spark, "digests")
    texts.select("row_id", "doc_id", sha.alias("text_sha256"), (sha if digest is None else digest).alias("digest")).write.parquet(landed)
    state = keyed_state(spark, landed, files_per_batch)

    decided = settle(
        spark.read.parquet(landed)
        .join(state, "digest")
        .select("row_id", "doc_id", "text_sha256", "digest", F.col("held.doc_id").alias("keep_id"), F.col("held.row_id").alias("keep_row"), "n")
    )
    alone = decided.filter("n = 1").select("row_id", "doc_id", "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    hits = settle(texts.select("row_id", "text").join(decided.filter("n > 1"), "row_id"))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    replicas = hits.filter("row_id = keep_row").select(
        "digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("text").alias("held_text")
    )
    compared = settle(
        hits.withColumn("salt", F.pmod(F.xxhash64("row_id"), salts).cast("int"))
        .join(replicas, ["digest", "salt"])
        .withColumn("same", F.col("text") == F.col("held_text"))
        .select("row_id", "doc_id", "text_sha256", "digest", "keep_id", "keep_row", "n", "same",
                F.when(~F.col("same"), F.col("text")).alias("other"))
    )
    others = compared.filter("not same")
    lost = others.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    same = (
        compared.filter("same")
        .join(lost, "digest", "left")
        .select("row_id", "doc_id", "keep_id", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"),
                (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
    )
    regrouped = others.groupBy("digest", "other").agg(F.max(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    apart = others.join(regrouped, ["digest", "other"]).select(
        "row_id", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(same).unionByName(apart)


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that are exact copies of a kept one; columns as they were."""
    return without_rows(docs, exact_groups(docs, id_column, text_column).filter("not kept"))
