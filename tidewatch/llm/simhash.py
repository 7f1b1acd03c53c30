"""SimHash near-dedup with sharded BK-trees.

Fingerprints are deduplicated first, so that a group of copies is one node. Two
fingerprints within the radius agree in at least ``blocks - radius`` of the blocks that
the 64 bits are cut into, so each fingerprint goes to one shard for each choice of so
many blocks, and linked fingerprints meet in a shard. ``blocks`` follows the number of
distinct fingerprints, so shards stay small; a shard of more than ``MEMBERS`` is split by
further blocks of the bits in which its members may differ. A shard builds a BK-tree
(children keyed by the Hamming distance to the parent) and looks every fingerprint up in
it along the edges within the radius only. A tree goes only to the task that holds its
shard: sending all trees to all tasks would grow with the corpus. Per shard a spanning set
of links is kept, which leaves the components as they are; components are then contracted
by joins. Very long texts are hashed a few hundred shingles at a time.

Defined results: null and empty texts have fingerprint zero, which is linked like any
other; null ids rank above all others, and the id of a component is null only if all of
its ids are; rows that repeat are copies; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .bktree import Forest

RADIUS = 3
#: Distinct fingerprints of a shard that one tree holds; larger shards are split, down to so few free bits that they have no more values than that.
MEMBERS, FEW = 4_096, 12
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(body: bytes, width: int) -> int:
    """The SimHash of a text's shingles, as a signed long."""
    words = body.translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        hashes = np.array([digest(joined, 42)], np.uint64)
    else:
        stops = [e - 1 for e in accumulate([len(w) + 1 for w in words])]
        starts = [0, *[e + 1 for e in stops[: n - 1]]]
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, stops[width - 1 :], strict=True)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, as a signed long."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # so that a byte holds every sum
        ones += np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, fp)"""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(body, width) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(fps, pa.int64())], names=["rid", "doc_id", "fp"])

    return common.keyed(docs, id_col, text_col).mapInArrow(run, "rid long, doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _pieces(free: int, n: int) -> list[int]:
    """The set bits of ``free`` in n runs of about equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def _masks(blocks: int, radius: int) -> list[int]:
    return [sum(c) for c in combinations(_pieces(2**64 - 1, blocks), blocks - radius)]


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """Members (mask, part, fp) of shards that are too large, in shards that agree in a further block of the bits left."""

    def run(batches):
        for batch in batches:
            mask, fp = (batch.column(c).to_numpy() for c in ("mask", "fp"))
            wide = np.empty((len(mask), radius + 1), np.int64)
            for m in np.unique(mask):
                wide[mask == m] = [_signed((int(m) | piece) % 2**64) for piece in _pieces(~int(m) % 2**64, radius + 1)]
            members = np.repeat(fp, radius + 1)
            yield pa.RecordBatch.from_arrays([pa.array(wide.ravel()), pa.array(wide.ravel() & members), pa.array(members)], names=["mask", "part", "fp"])

    return rows.select("mask", "fp").mapInArrow(run, "mask long, part long, fp long")


def _linked(batches, radius: int):
    """(a, b): each member of a shard that is linked within it with one that stands for all of these."""
    for t, bounds in _whole_shards(batches, ["mask", "part"]):
        fp = t.column("fp").to_numpy().view(np.uint64)
        label = Forest(fp, bounds).link(radius)
        some = np.flatnonzero(label != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[some].view(np.int64)), pa.array(fp[label[some]].view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, most: int = MEMBERS) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of ``fp`` (distinct) within the radius."""
    if blocks is None:
        n = distinct.count()
        blocks = radius + 1 if n < 2**23 else radius + 2 if n < 2**31 else radius + 3
    shards = F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("part")) for m in _masks(blocks, radius)])
    rows = distinct.select("fp", F.explode(shards).alias("s")).select("s.mask", "s.part", "fp")
    while True:
        large = common.cut(rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most) & (F.bit_count("mask") < 64 - FEW)))
        if large.isEmpty():
            break
        marked = rows.join(large, ["mask", "part"], "left")
        rows = common.cut(marked.filter("n is null").select("mask", "part", "fp").unionByName(_split(marked.filter("n is not null"), radius)))
    return rows.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(partial(_linked, radius=radius), "a long, b long")


def components(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, doc_id, fp) with ``component_id``, the smallest id linked, and ``lead``, the row id of one row with it."""
    distinct = common.cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")))
    roots = graph.components(links(distinct.select("fp")))
    placed = common.cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    lead = placed.groupBy("root").agg(F.min("least").alias("least"))
    by_fp = placed.select("fp", "root").join(lead, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("lead"))
    return rows.join(by_fp, "fp")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprint and component of every document."""
    rows = common.cut(fingerprints(common.table(spark, sf_dir, "documents")))
    return components(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar texts: documents whose shingles are counted, and how many shingles that recur there are told apart.
SAMPLE, COMMON = 8_000, 100_000
#: Fingerprints of similar texts differ in fewer bits, but for a few in a hundred pairs at the threshold.
NEAR = 14
#: Bytes of a parity bitmap of shingles.
PARITY = 256
ODD = np.random.default_rng(37).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(body: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words (of all words if there are fewer)."""
    words = body.translate(FOLD).split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 9)][: len(words)], np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 9) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * ODD[k % len(ODD)] + h[k : k + n]
    return np.unique((out ^ (out >> np.uint64(32))) * ODD[0])


def parity(h: np.ndarray) -> bytes:
    """Bits of how many hashes fall on each, modulo 2; the bitmaps of two sets differ in no more bits than the sets in members."""
    count = np.bincount((h >> np.uint64(40)).astype(np.int64) % (8 * PARITY), minlength=8 * PARITY)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def possible(n_a, room_a, n_b, room_b, similarity: float):
    """Whether sets of so many members, of which so many are left from the first common one on, can be that similar."""
    return np.minimum(room_a, room_b) >= similarity / (1 + similarity) * (n_a + n_b) - 1e-6


def _alike(i, j, n, room, root, bits, similarity: float) -> np.ndarray:
    """Of pairs of places: which have different roots and are not ruled out by sizes or bitmaps."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        at = np.flatnonzero((root[x] != root[y]) & possible(n[x], room[x], n[y], room[y], similarity))
        differ = np.bitwise_count(bits[x[at]] ^ bits[y[at]]).sum(1, dtype=np.int64)
        out[k + at] = differ <= (1 - similarity) / (1 + similarity) * (n[x[at]] + n[y[at]]) + 1e-6
    return out


#: Members of a shard of which all pairs are looked at together.
FEW_MEMBERS = 8


def small_pairs(bounds) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within the shards of at most FEW_MEMBERS."""
    first, size = bounds[:-1], np.diff(bounds)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, FEW_MEMBERS + 1):
        a, b = np.triu_indices(m, 1)
        at = first[size == m][:, None]
        i.append((at + a).ravel())
        j.append((at + b).ravel())
    return np.concatenate(i), np.concatenate(j)


def other_pairs(n, room, root, bits, similarity: float, spanning: bool) -> list[tuple[int, int]]:
    """All pairs of places of a shard but those that have one ``root`` and those that sizes or bitmaps (a row of words each) rule out; or a forest that spans these."""
    order, out = np.argsort(n, kind="stable"), []
    n, room, root, bits = n[order], room[order], root[order], bits[order]
    for i, e in enumerate(np.searchsorted(n, n / similarity + 1e-6, "right").tolist()):
        at = np.arange(i + 1, e)
        at = at[_alike(np.full(len(at), i), at, n, room, root, bits, similarity)]
        if spanning and len(at):
            joined, one = np.unique(root[at], return_index=True)
            root[np.isin(root, joined)] = root[i]
            at = at[one]
        out += [(int(order[i]), int(order[k])) for k in at]
    return out


def _whole_shards(batches, key: list[str] = ["key"]):  # noqa: B006
    """Tables of whole shards and the bounds of these, from batches sorted by the key; held are a batch and a shard."""

    def bounds(t):
        new = np.zeros(t.num_rows - 1, bool)
        for c in key:
            x = t.column(c).to_numpy()
            new |= x[1:] != x[:-1]
        return np.flatnonzero(np.concatenate(([True], new, [True])))

    value = lambda t, i: tuple(t.column(c)[i].as_py() for c in key)
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and value(batch, batch.num_rows - 1) == value(kept[-1], 0):
            kept.append(batch)
            continue
        last = int(bounds(batch)[-2])
        t = pa.Table.from_batches([*kept, batch.slice(0, last)]).combine_chunks()
        if t.num_rows:
            yield t, bounds(t)
        kept = [batch.slice(last)]
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, bounds(t)


def common_shingles(source: DataFrame, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that recur in a sample of texts, with their counts: they come last in the order of all shingles."""

    def run(batches):
        for batch in batches:
            out = [np.zeros(0, np.int64), *(shingles(b.as_py(), width).view(np.int64) for b in batch.column("body"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["h"])

    some = source.filter(F.pmod(F.xxhash64("rid"), F.lit(max(1, n_docs // SAMPLE))) == 0)
    rows = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([(r.h, r.n) for r in rows], np.int64).reshape(-1, 2).T
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def keys(source: DataFrame, similarity: float, width: int) -> DataFrame:
    """(key, rid, n, room, fp): the shards of a text, its number of shingles, how many of them texts that meet first in the shard can share, and the SimHash of its shingles.

    Shards are the first shingles of a text in an order of all shingles, rare ones before
    common ones. So many of them are taken that the others are too few for the similarity,
    hence similar texts meet at the first shingle that both have, whatever the order is.
    """
    hot, counts = common_shingles(source, source.count(), width)

    def run(batches):
        for batch in batches:
            out, sizes, room, fps = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int32)], []
            for body in batch.column("body"):
                h = shingles(body.as_py(), width)
                n = len(h)
                fps.append(majority(h))
                first = n - math.ceil(similarity * n - 1e-6) + 1 if n else 0
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    h = h[np.argsort(np.where(hot[at] == h, counts[at], 0), kind="stable")]
                out.append(h[:first].view(np.int64))
                sizes.append((first, n))
                room.append(np.arange(n, n - first, -1, dtype=np.int32))
            many, n = np.array(sizes, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(batch.column("rid").to_numpy(), many)), pa.array(np.repeat(n, many).astype(np.int32)), pa.array(np.concatenate(room)), pa.array(np.repeat(np.array(fps, np.int64), many))], names=["key", "rid", "n", "room", "fp"])

    return source.mapInArrow(run, "key long, rid long, n int, room int, fp long")


def nearest(fp: np.ndarray, bounds: np.ndarray, radius: int = NEAR) -> np.ndarray:
    """For members of shards (fp unsigned, they may repeat): the place of the first that the BK-tree of the shard links each with."""
    shard = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((fp, shard))
    new = np.concatenate(([True], (fp[order][1:] != fp[order][:-1]) | (shard[order][1:] != shard[order][:-1])))
    distinct = order[new]
    edges = np.searchsorted(shard[distinct], np.arange(len(bounds)))
    label = Forest(fp[distinct], edges).link(radius)[np.cumsum(new) - 1]
    least = np.full(len(distinct), len(fp))
    np.minimum.at(least, label, order)
    out = np.empty(len(fp), np.int64)
    out[order] = least[label]
    return out


def linked_by_trees(shards: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of ``keys`` in whole sorted shards: the shards (key, rid, n, room) that may hold similar texts, and pairs (a, b), each text with the one that the BK-trees of most of its shards link it with."""

    def run(batches):
        for t, bounds in _whole_shards(batches):
            size = np.diff(bounds)
            t = t.filter(pa.array(np.repeat(size > 1, size))).combine_chunks()
            size = size[size > 1]
            if not len(size):
                continue
            bounds = np.concatenate(([0], np.cumsum(size)))
            rid, n, room, fp = (t.column(c).to_numpy() for c in ("rid", "n", "room", "fp"))
            place, head, hub = np.arange(len(rid)), np.repeat(bounds[:-1], size), nearest(fp.view(np.uint64), bounds)
            asked = (hub != place) & possible(n[hub], room[hub], n, room, similarity)
            second = (head != place) & possible(n[head], room[head], n, room, similarity)
            keep = np.repeat((size > 2) | np.logical_or.reduceat(second, bounds[:-1]), size)
            columns = ["key", "rid", "n", "room"]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in columns), pa.array(np.where(asked, rid[hub], -1))], names=[*columns, "hub"]).filter(pa.array(keep))

    met = common.freed(shards.mapInArrow(run, "key long, rid long, n int, room int, hub long"))
    asked = met.filter("hub >= 0").groupBy("rid", "hub").agg(F.count(F.lit(1)).alias("often"))
    return met.drop("hub"), common.freed(asked.groupBy(F.col("rid").alias("b")).agg(F.max_by("hub", F.struct("often", -F.col("hub"))).alias("a")))


def packed(source: DataFrame, who: DataFrame, width: int | None = None) -> DataFrame:
    """(rid, body, bits): the texts of the rows ``who`` (rid), compressed, and with ``width`` the bitmaps of their shingles.

    A bitmap of row ids keeps other texts from being shuffled.
    """

    def run(batches):
        for batch in batches:
            bodies = [b.as_py() for b in batch.column("body")]
            bits = [None if width is None else parity(shingles(b, width)) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([zlib.compress(b, 1) for b in bodies], pa.binary()), pa.array(bits, pa.binary())], names=["rid", "body", "bits"])

    who = common.cut(who.distinct())
    some = common.marked(source.select("rid", "body"), common.bitmap(who, "rid"), "rid").filter("open").drop("open")
    return common.freed(some.join(who.hint("shuffle_hash"), "rid", "left_semi").mapInArrow(run, "rid long, body binary, bits binary"))


def verified(found: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of ``found`` whose texts (packed) have that similarity, decided by their shingles."""

    def decide(batches):
        for batch in batches:
            keep, last, held = [], None, None
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("body_a"), batch.column("body_b"), strict=True):
                if b != last:
                    last, held = b, shingles(zlib.decompress(y.as_py()), width)
                one = shingles(zlib.decompress(x.as_py()), width)
                both = len(np.intersect1d(one, held, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(held) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("rid").alias(c), F.col("body").alias(f"body_{c}")) for c in "ab")
    return common.freed(found.join(left, "a").join(right, "b").mapInArrow(decide, "a long, b long"))


def similar(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b), row ids of texts whose sets of ``width``-word shingles have at least this Jaccard similarity.

    Their closure is that of all such pairs. First SimHash links them: shards of texts that
    have a shingle in common hold their fingerprints in BK-trees, which link all within
    ``NEAR`` bits, and the shingles decide on each text and the one it is linked with. What
    fingerprints miss is found exactly: later rounds leave out pairs that
    verified links join and those that sizes or parity bitmaps rule out (none of that
    similarity). The second compares a forest of the others, one pair for any two groups;
    the third compares all that are left. The shingles decide.
    """
    source = common.keyed(docs, id_col, text_col)
    shards = keys(source, similarity, width).repartition("key").sortWithinPartitions("key", "rid")

    def unsettled(batches):
        for t, bounds in _whole_shards(batches):
            root, size = t.column("root").to_numpy(), np.diff(bounds)
            mixed = np.minimum.reduceat(root, bounds[:-1]) != np.maximum.reduceat(root, bounds[:-1])
            yield t.combine_chunks().to_batches()[0].filter(pa.array(np.repeat(mixed, size)))

    def rest(batches, spanning):
        for t, bounds in _whole_shards(batches):
            rid, n, room, root = (t.column(c).to_numpy() for c in ("rid", "n", "room", "root"))
            n = n.astype(np.int64)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(rid), -1)
            i, j = small_pairs(bounds)
            some = _alike(i, j, n, room, root, bits, similarity)
            more = [np.stack([i[some], j[some]], 1)]
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s > FEW_MEMBERS:
                    more.append(np.array(other_pairs(n[s:e], room[s:e], root[s:e], bits[s:e], similarity, spanning), np.int64).reshape(-1, 2) + s)
            at = np.concatenate(more)
            pairs = np.unique(np.concatenate([np.sort(rid[at], 1), np.sort(root[at], 1)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], names=["a", "b", "one", "two"])

    open_rows, found = linked_by_trees(shards, similarity)
    links = verified(found, packed(source, found.select(F.col("a").alias("rid")).unionByName(found.select(F.col("b").alias("rid")))), similarity, width)
    texts = None
    for spanning in (True, False):
        roots = graph.components(links).withColumnRenamed("node", "rid")
        rows = open_rows.join(roots, "rid", "left").select("key", "rid", "n", "room", F.coalesce("root", "rid").alias("root"))
        open_rows = common.freed(rows.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(unsettled, "key long, rid long, n int, room int, root long"))
        if texts is None:  # the last round has no other texts
            texts = packed(source, open_rows.select("rid"), width)
        dealt = open_rows.join(texts.select("rid", "bits"), "rid").repartition("key").sortWithinPartitions("key", "rid")
        found = dealt.mapInArrow(partial(rest, spanning=spanning), "a long, b long, one long, two long")
        if spanning:
            found = found.groupBy("one", "two").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
        links = links.unionByName(verified(common.freed(found.select("a", "b").distinct()), texts, similarity, width))
        open_rows = open_rows.drop("root")
    return links


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of texts linked by a similarity of 0.8 or more one document stays (the first in the table), with its columns.

    Equal texts without words are left to exact dedup.
    """
    return common.without(docs, graph.components(similar(docs)).filter("node <> root").select(F.col("node").alias("rid")))
