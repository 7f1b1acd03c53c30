"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are grouped by length, then by the hash of a prefix, then by the SHA-256 of the
whole normalised text (A-Z lowered). Only groups that still have two rows go on, and
content is read in full for these alone. The first two levels are small aggregates:
lengths and (length, prefix hash) pairs are pre-aggregated by every task. The pairs
that survive are sent to the last scan as a bitmap of one megabyte, whose
size is fixed whatever the input: a false positive costs one digest and changes no
result, as rows are grouped by the digest in the end. So texts are never shuffled.

Defined results: null texts equal empty ones; of equal texts the row with the largest
id stays (null ids rank lowest; of repeated rows with that id one row stays, the last
of the scan); very long texts are digested where they are; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX = 64


def _signature(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body"), F.monotonically_increasing_id().alias("rid"), F.octet_length(text).alias("len"), F.xxhash64(common.lowered(F.substring(text, 1, PREFIX))).alias("head"))


def _survivors(rows: DataFrame) -> DataFrame:
    """The bitmap of (length, prefix hash) pairs that two rows share."""
    # level 1: lengths that two rows have; level 2: of these, prefixes that two rows have
    pairs = rows.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n"))
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("rows")).filter("rows > 1").select("len")
    return common.bitmap(pairs.join(lengths, "len", "left_semi").filter("n > 1"), "len", "head")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: rid, doc_id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null for rows that an earlier level has settled, unless ``digest_all``.
    """
    rows = _signature(docs, id_col, text_col)
    marked = common.marked(rows, _survivors(rows), "len", "head")
    # level 3: the whole content of what is left
    digest = F.unhex(F.sha2(common.lowered(F.col("body")).cast("binary"), 256))
    if not digest_all:
        digest = F.when(F.col("open"), digest)
    narrow = common.cut(marked.select("rid", "doc_id", "len", "open", digest.alias("digest")))
    last = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "rid", "doc_id"))
    groups = narrow.filter("open").groupBy("len", "digest").agg(last.alias("last"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = groups.select(F.col("digest").alias("key"), F.col("last.rid").alias("keep_rid"), F.col("last.doc_id").alias("keep_id"), "size")
    # a settled row joins nothing; its own key spreads such rows evenly
    own = F.coalesce("digest", F.col("rid").cast("string").cast("binary"))
    out = narrow.withColumn("key", own).join(groups, "key", "left")
    alone = F.col("size").isNull()
    return out.select("rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the row that stays, group size and digest for every document."""
    return dedup(common.table(spark, sf_dir, "documents"), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one row of each group stays, with its columns."""
    return common.without(docs, dedup(docs).filter(~F.col("kept")))


ORACLE = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from n group by body)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.body) as text_sha256
from n join g on n.body = g.body
"""
