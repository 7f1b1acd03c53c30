"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits by which A-Z is lowered and nothing else (``lower()`` would also change other letters).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, so that later reads neither recompute nor depend on an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files go when the query ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freed(df: DataFrame) -> DataFrame:
    """As ``cut``; the shuffle files that the rows were made from are deleted at once, so the disk holds one step's at a time."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut(df.select("*"))
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def lowered(text):
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


#: 2**23 bits, one megabyte for the broadcast.
BITMAP_BITS = 23


def bitmap(rows: DataFrame, *columns: str) -> DataFrame:
    """(part, bits): a bitmap of fixed size with a bit for each of the values."""
    slots = rows.select(F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITMAP_BITS).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def marked(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``open``: whether the bit of the values is set in the bitmap ``found``, which is broadcast. Values that the bitmap was not made of may have one too."""
    slot = F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITMAP_BITS)
    both = rows.withColumns({"slot": slot, "part": F.bitmap_bucket_number(slot)}).join(F.broadcast(found), "part", "left")
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return both.withColumn("open", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("slot", "part", "bits")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose number in the scan is in ``gone`` (rid). Only rows that a bitmap of these doesn't clear are shuffled; columns may have any names."""
    gone = cut(gone.select("rid").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = marked(rows, bitmap(gone, "rid"), "rid")
    kept = rows.filter("open").join(gone.hint("shuffle_hash"), "rid", "left_anti").select("row")
    return rows.filter("not open").select("row").unionByName(kept).select("row.*")


#: Bytes of a batch that Python is handed at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, however long texts are: batches end at BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``rid``, ``doc_id``, ``body``): a row key that is unique even where ids repeat, the id, and the whole text as bytes (null: empty).

    ``rid`` follows the order of the scan; it is the same in every scan of the same files,
    so it joins branches of one plan. ``docs`` must be replayable, as a table scan is.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).withColumn("rid", F.monotonically_increasing_id())
