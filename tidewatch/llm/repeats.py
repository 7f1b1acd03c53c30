"""Repeated passages of a fixed span: what substring dedup by words and by bytes have in common.

A text is a sequence of symbols (bytes, or hashes of words). Of every run of ``window``
positions the one whose k-gram has the least hash is its anchor, so every span of
``span`` symbols has an anchor among its first ``window`` positions, at the same place in
each of its occurrences. Anchors are a few in a hundred positions. The symbols from an
anchor up to the span's least reach are its prefix: only anchors with a prefix that a
second anchor has can lie in a repeated span. Anchors whose whole surroundings (all spans
that they can stand for) are equal are counted together before anything is shipped;
one of them, the first by (id, row, place), stands for all.

The operators then compare the surroundings themselves; this module's hashes only choose
what is compared and count equal surroundings. Ranges are hashed by their k-grams, each
mixed before, so that regular texts have no regular hashes.

Where very many kinds of surroundings share a prefix, ``refined`` splits them: the spans
that start 0 to 2n-1 places before an anchor are those of 0 to n-1 and those of n to 2n-1,
and either half has a longer prefix, which fewer anchors share. Kinds that agree in all
symbols of a half are one kind there. At the end a half is one span, which is its prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes of text handled at once (a longer text is handled alone).
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Powers:
    """BASE**i and its inverse, modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


class Hashes:
    """Hashes of all ranges of a symbol sequence."""

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        powers.reach(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers.up[:n], out=self.sums[1:])
        self.down = powers.down

    def of(self, start, stop) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


@dataclass(frozen=True)
class Shape:
    span: int
    window: int
    gram: int

    @property
    def prefix(self) -> int:
        return self.span - self.window + 1

    def anchors(self, values: np.ndarray, bounds: np.ndarray, powers: Powers):
        """(document, place, prefix hash, surroundings hash) of the anchors in concatenated texts; bounds: where texts start, and the end."""
        none = np.zeros(0, np.int64)
        w, k, n = self.window, self.gram, len(values)
        if n < self.span:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        hashes = Hashes(values, powers)
        at = np.arange(n - k + 1)
        h = hashes.of(at, at + k)
        m, size = h, 1
        while 2 * size <= w:
            m, size = np.minimum(m[:-size], m[size:]), 2 * size
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        # starts of spans that lie within one text
        ok = np.zeros(n + 1, np.int8)
        first, last = bounds[:-1], bounds[1:] - self.span
        long = last >= first
        ok[first[long]] += 1
        ok[last[long] + 1] -= 1
        valid = np.flatnonzero(np.cumsum(ok[:-1]))
        if not len(valid):
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        before = np.maximum(valid - 1, 0)
        opens = np.zeros(n, bool)
        opens[first[long]] = True
        fresh = opens[valid]
        entered = m[valid] < m[before]
        left = h[before] == m[before]
        new = valid[entered & ~fresh] + w - 1
        search = valid[fresh | (left & ~entered)]
        found = [new]
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        for i in range(0, len(search), 4096):
            some = search[i : i + 4096]
            found.append(some + np.argmax(view[some] == m[some][:, None], axis=1))
        a = np.unique(np.concatenate(found))
        doc = np.searchsorted(bounds, a, "right") - 1
        lo, hi = np.maximum(a - w + 1, bounds[doc]), np.minimum(a + self.span, bounds[doc + 1])
        grams = Hashes(h, powers)
        around = mix(grams.of(lo, hi - k + 1) + (a - lo).astype(np.uint64) * np.uint64(BASE) + (hi - a).astype(np.uint64))
        return doc, a - bounds[doc], grams.of(a, a + self.prefix - k + 1), around


def chunks(bodies: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of about CHUNK bytes each."""
    i = 0
    while i < len(bodies):
        j, size = i, 0
        while j < len(bodies) and (j == i or size + len(bodies[j]) <= CHUNK):
            size += len(bodies[j])
            j += 1
        yield i, bodies[i:j]
        i = j


def candidates(docs: DataFrame, shape: Shape, symbols: Callable) -> DataFrame:
    """Anchors (doc_id, rid, pos, key, ctx) whose prefix a second anchor has, cut. symbols: texts -> (values, bounds)."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            rid, ids = batch.column("rid").to_numpy(), batch.column("doc_id")
            for i, bodies in chunks(batch.column("body").to_pylist()):
                values, bounds = symbols(bodies, powers)
                doc, pos, key, ctx = shape.anchors(values, bounds, powers)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + i)), pa.array(rid[doc + i]), pa.array(pos.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))], names=["doc_id", "rid", "pos", "key", "ctx"])

    anchors = docs.mapInArrow(run, "doc_id long, rid long, pos int, key long, ctx long")
    # written first, so that the join below reads it by an exchange of its own and very frequent keys can be split
    repeated = common.freed(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    return common.freed(anchors.join(repeated.hint("shuffle_hash"), "key", "left_semi").select("doc_id", "rid", "pos", "key", "ctx"))


def standing(found: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """One row for all anchors of equal surroundings: key, ctx, n, the first of them as doc_id, rid, pos; and of its key: whether surroundings ``differ``, ``many`` if there are more than ``hot`` kinds. Second: whether any key has so many."""
    first = F.min(F.struct("doc_id", "rid", "pos"))  # null ids come first
    rows = found.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), first.alias("r"))
    kinds = found.groupBy("key").agg(F.approx_count_distinct("ctx", 0.02).alias("about"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
    kinds = common.freed(kinds.select("key", (F.col("low") != F.col("high")).alias("differ"), (F.col("about") > hot).alias("many")))
    rows = rows.join(kinds.hint("shuffle_hash"), "key").select("key", "ctx", "n", "r.rid", "r.pos", "differ", "many")
    return rows, not kinds.filter("many").isEmpty()


def surroundings(docs: DataFrame, rows: DataFrame, extract: Callable, bucket: Callable | None = None) -> DataFrame:
    """``rows`` with ``lead`` and ``rest``: the symbols before the anchor and from it on, the ``bucket`` of ``rest``, and the key as ``part``.

    extract: (text, places) -> two lists of bytes. Texts are shuffled once for this and for
    what ``joined`` does with the same documents.
    """
    cols = ["key", "ctx", "n", "pos", "many"]
    per_doc = rows.groupBy("rid").agg(F.collect_list(F.struct(*cols)).alias("rows"))  # as many as a text has anchors
    kinds = {"key": pa.int64(), "ctx": pa.int64(), "n": pa.int64(), "pos": pa.int32(), "many": pa.bool_()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("rows")
            flat, counts = own.flatten(), np.diff(own.offsets.to_numpy())
            places = flat.field("pos").to_numpy(zero_copy_only=False)
            lead, rest, at = [], [], 0
            for body, n in zip(batch.column("body"), counts.tolist(), strict=True):
                a, b = extract(body.as_py(), places[at : at + n])
                lead += a
                rest += b
                at += n
            whose = pa.array(np.repeat(np.arange(len(counts)), counts))
            placed = [0] * len(rest) if bucket is None else [bucket(x) for x in rest]
            yield pa.RecordBatch.from_arrays([*(flat.field(c).cast(k) for c, k in kinds.items()), batch.column("rid").take(whose), batch.column("doc_id").fill_null(-(2**63)).take(whose), pa.array(lead, pa.binary()), pa.array(rest, pa.binary()), pa.array(placed, pa.int32())], names=[*cols, "rid", "doc_id", "lead", "rest", "bucket"])

    schema = "key long, ctx long, n long, pos int, many boolean, rid long, doc_id long, lead binary, rest binary, bucket int"
    return joined(docs, per_doc, "rows", "inner").mapInArrow(run, schema).withColumn("part", F.col("key"))


#: What is compared of a kind of surroundings, and which kind of an anchor it is.
KIND = ["part", "key", "ctx", "n", "doc_id", "rid", "pos", "lead", "rest"]


def _halves(batches, trim: Callable):
    """Both halves of what is open: the kind's symbols that a half's spans cover, and ``head``, a hash of what all of these spans cover (it only chooses what is compared)."""
    names = ["key", "ctx", "doc_id", "rid", "pos"]
    for batch in batches:
        row, low, high, lead, rest, head = [], [], [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("low", "high", "lead", "rest"))
        for i, (l, h, x, y) in enumerate(zip(*columns, strict=True)):
            middle = (l + h) // 2
            for a, b in ((l, middle), (middle + 1, h)) if l < h else ():
                if (got := trim(x, y, a, b)) is not None:
                    row.append(i)
                    low.append(a)
                    high.append(b)
                    lead.append(got[0])
                    rest.append(got[1])
                    head.append(xxhash.xxh64_intdigest(got[2], b) - 2**63)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *(pa.array(x, pa.int32()) for x in (low, high)), *(pa.array(x, pa.binary()) for x in (lead, rest)), pa.array(head, pa.int64())], names=[*names, "low", "high", "lead", "rest", "head"])


def refined(rows: DataFrame, window: int, hot: int, trim: Callable) -> tuple[DataFrame, DataFrame]:
    """Kinds of surroundings whose prefix more than ``hot`` share (rows: KIND), split until no more than that share one.

    First: rows of KIND whose ``part`` is to be compared together; their ``lead`` and ``rest``
    reach as far as the spans in question only, which are nobody else's. Second: (key, ctx,
    lead, rest, first), kinds that agree with an earlier one in all that such spans cover, or
    are the first of such kinds.
    """
    schema = "key long, ctx long, doc_id long, rid long, pos int, low int, high int, lead binary, rest binary, head long"
    half = ["low", "high", "lead", "rest"]
    open_ = rows.select("key", "ctx", "doc_id", "rid", "pos", F.lit(0).alias("low"), F.lit(window - 1).alias("high"), "lead", "rest")
    ready = equal = None
    while True:
        halves = common.cut(open_.mapInArrow(partial(_halves, trim=trim), schema))
        kinds = common.cut(halves.groupBy(*half, "head").agg(F.min(F.struct("doc_id", "rid", "pos", "key", "ctx")).alias("p"), F.count(F.lit(1)).alias("c")))
        twice = kinds.filter("c > 1").select(*half, F.col("p.rid").alias("first_rid"), F.col("p.pos").alias("first_pos"))
        same = halves.join(twice, half).select("key", "ctx", "lead", "rest", ((F.col("rid") == F.col("first_rid")) & (F.col("pos") == F.col("first_pos"))).alias("first"))
        heads = kinds.groupBy("low", "high", "head").agg(F.count(F.lit(1)).alias("sharing")).filter("sharing > 1")
        shared = common.cut(kinds.join(heads, ["low", "high", "head"]).select("p.*", "low", "high", "lead", "rest", "sharing", F.xxhash64("low", "high", "head").alias("part")))
        done = shared.filter(F.col("sharing") <= hot).withColumn("n", F.lit(1).cast("long")).select(*KIND)
        ready = done if ready is None else ready.unionByName(done)
        equal = same if equal is None else equal.unionByName(same)
        open_ = shared.filter(F.col("sharing") > hot)
        if open_.isEmpty():
            return ready, equal


def parts(batches, columns: list[str], rows: int = 4_096) -> Iterator[dict[str, np.ndarray | list]]:
    """Whole parts from batches sorted by ``part``, at least so many rows at a time: longs as arrays, bytes as lists; held are these and a batch."""
    kept: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(kept)
        return {c: t.column(c).to_pylist() if pa.types.is_binary(t.column(c).type) else t.column(c).to_numpy() for c in columns}

    size = 0
    for batch in batches:
        start, key = 0, batch.column("part").to_numpy()
        for cut in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]:
            if size + cut - start >= rows:
                kept.append(batch.slice(start, cut - start))
                yield flush()
                kept, size, start = [], 0, cut
        if len(key) > start:
            if size >= rows and kept[-1].column("part")[-1].as_py() != key[start]:
                yield flush()
                kept, size = [], 0
            kept.append(batch.slice(start))
            size += len(key) - start
    if kept:
        yield flush()


def joined(docs: DataFrame, per_doc: DataFrame, column: str, how: str) -> DataFrame:
    """Documents with what was found for each; the small side is hashed, so texts aren't sorted."""
    return docs.select("rid", "doc_id", "body").join(per_doc.hint("shuffle_hash"), "rid", how).select("rid", "doc_id", "body", column)


def covered(starts: np.ndarray, span: int, length: int) -> np.ndarray:
    """Which symbols lie in a span from one of the starts."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span, -1)
    return np.cumsum(edge[:-1]) > 0


def starts_of(pos: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Starts of spans: bit o of an anchor's mask (words of 64 bits, in columns) is the span that starts o before it."""
    bits = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little")
    row, o = np.nonzero(bits)
    return np.unique(pos[row] - o)
