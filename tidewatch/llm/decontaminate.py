"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every item gives its windows of ``width`` consecutive words (an item of fewer words,
but not none, is one window). The windows of one length form a pattern set with a
shift table over blocks of two words: the table tells how far the search may move on
without missing a pattern. Where the shift is zero, the bucket of the block that ends
there, then the first block, select the patterns to test, and the words themselves are
compared. Documents are streamed once for each block of items; items are loaded in
blocks of at most ``MAX_ITEM_BYTES`` of text, so what is sent to the executors is bounded.

Defined results: null or empty texts have no words and no hits; items without words
match nothing; repeated rows are searched alike; an item whose id is null marks words
but is in no list of ids; very long texts are searched whole, one at a time; empty tables
give no rows or no hits; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text of benchmark items that one pass holds in memory.
MAX_ITEM_BYTES = 16_000_000
WIDTH = 10
#: Bytes of a word are 0-9, a-z and all from 0x80; A-Z are lowered, everything else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def words_of(body: bytes) -> list[bytes]:
    return body.translate(FOLD).split()


class WuManber:
    """Patterns of one length (in words), at least two."""

    def __init__(self, length: int):
        self.length = length
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, list]]] = {}

    def add(self, pattern: tuple, item) -> None:
        last = self.length - 1
        for j in range(1, self.length):
            block = pattern[j - 1 : j + 1]
            if self.shift.get(block, last) > last - j:
                self.shift[block] = last - j
        tests = self.buckets.setdefault(pattern[-2:], {}).setdefault(pattern[:2], {})
        items = tests.setdefault(pattern, [])
        if not items or items[-1] != item:
            items.append(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence."""
        shift, last, buckets = self.shift.get, self.length - 1, self.buckets
        at, n = last, len(words)
        while at < n:
            block = (words[at - 1], words[at])
            move = shift(block, last)
            if move:
                at += move
                continue
            start = at - last
            tests = buckets[block].get((words[start], words[start + 1]))
            if tests:
                items = tests.get(tuple(words[start : at + 1]))
                if items:
                    yield start, items
            at += 1


class Patterns:
    """The windows of a block of items, by length."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.sets: dict[int, WuManber] = {}
        self.single: dict[bytes, list] = {}
        for item, body in items:
            words = words_of(body)
            length = min(width, len(words))
            if length == 1:
                self.single.setdefault(words[0], []).append(item)
            elif length:
                into = self.sets.setdefault(length, WuManber(length))
                for i in range(len(words) - length + 1):
                    into.add(tuple(words[i : i + length]), item)

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs of words inside any occurrence, and the items that occur."""
        found, items = [], set()
        for length, patterns in self.sets.items():
            for start, hit in patterns.search(words):
                found.append((start, start + length))
                items.update(hit)
        if self.single:
            for i, w in enumerate(words):
                if w in self.single:
                    found.append((i, i + 1))
                    items.update(self.single[w])
        if len(found) > 1:
            found.sort()
            merged = [found[0]]
            for s, e in found[1:]:
                if s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            found = merged
        items.discard(None)
        return found, items


def _pass(docs: DataFrame, items: list[tuple[str | None, bytes]], width: int) -> DataFrame:
    def scan(batches):
        patterns = Patterns(items, width)
        for batch in batches:
            n_words, spans, ids = [], [], []
            for body in batch.column("body").to_pylist():
                words = words_of(body)
                runs, hit = patterns.spans(words)
                n_words.append(len(words))
                spans.append([{"start": s, "stop": e} for s, e in runs])
                ids.append(sorted(hit))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(ids, pa.list_(pa.string()))], names=["rid", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(scan, "rid long, doc_id long, n_words long, spans array<struct<start: long, stop: long>>, items array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """One row per document: rid, doc_id, n_words, ``spans`` (word ranges inside an occurrence, merged), ``items`` (ids as sorted strings)."""
    source = common.keyed(docs, id_col, text_col)
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("body"))
    total = tests.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // max_item_bytes))
    found = None
    for k in range(blocks):  # one pass over the documents for each bounded block of items
        part = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("body", "item"), F.lit(blocks)) == k)
        seen = _pass(source, [(r["item"], bytes(r["body"])) for r in part.toLocalIterator()], width)
        found = seen if found is None else found.unionByName(seen)
    if blocks == 1:
        return found
    order = F.array_sort(F.flatten(F.collect_list("spans")))
    # touching or overlapping ranges of one document become one
    start = F.struct(F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)").alias("done"))
    merged = F.aggregate(
        order, start["done"],
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(x))),
    )
    return found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: word hits, items and the verdict for every document."""
    found = find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without any hit stay, with their columns; rows are tested where they are, without a shuffle."""
    common.small_batches(spark)
    tests = common.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    total = tests.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // MAX_ITEM_BYTES))
    for k in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("body", "item"), F.lit(blocks)) == k)
        docs = _without_hits(docs, [(r["item"], bytes(r["body"])) for r in part.toLocalIterator()])
    return docs


def _without_hits(docs: DataFrame, items: list[tuple[str | None, bytes]], text_col: str = "text") -> DataFrame:
    def scan(batches):
        patterns = Patterns(items, WIDTH)
        for batch in batches:
            keep = [body is None or not patterns.spans(words_of(body))[0] for body in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
