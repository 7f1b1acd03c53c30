"""Substring dedup over bytes by a distributed, sparse suffix array.

Suffixes start at anchors (``repeats``); those whose leading bytes no second suffix has
cannot lie in a repeated string of ``SPAN`` bytes and are left out. The rest are range
partitioned by their leading bytes with sampled splitters. A bucket sorts its suffixes by
multikey quicksort over characters of eight bytes, and the reversed bytes before them
likewise; common lengths with the neighbours in both orders tell for each of the spans
around a suffix which others have it. Suffixes with equal leading bytes are in one
bucket, so nothing crosses a boundary, unless more than ``HOT`` kinds of surroundings
share these bytes: such a bucket is split at its middle into the suffixes as they are and
those that start up to half a window earlier, with so many more leading bytes, again and
again (``repeats.refined``); bytes decide there too.

Defined results: null texts are empty; texts under ``SPAN`` bytes keep everything; all
occurrences are removed, the first too; repeated rows are occurrences of each other;
texts need not be valid UTF-8 after removal, as the kept bytes are counted in bytes; very
long texts are handled one at a time; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

SPAN = 200
#: Kinds of surroundings of equal leading bytes that are sorted together (about 100 MB of a task); suffixes sampled for splitters.
HOT, SAMPLE = 32_768, 4_000
SHAPE = repeats.Shape(SPAN, 128, 16)
TABLE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)


def symbols(bodies: list[bytes], powers) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
    return TABLE[np.frombuffer(b"".join(bodies), np.uint8)], bounds


def extract(body: bytes, places: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    at = places.tolist()
    return [body[max(0, p - SHAPE.window + 1) : p] for p in at], [body[p : p + SPAN] for p in at]


def multikey_order(chars: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of 64-bit characters: partition by one character, go on to the next where rows are equal."""
    order = np.argsort(chars[:, 0], kind="stable")
    group = np.concatenate(([0], np.cumsum(chars[order[1:], 0] != chars[order[:-1], 0]))) if len(order) else order
    for c in range(1, chars.shape[1]):
        size = np.bincount(group)
        open_ = np.flatnonzero(size[group] > 1)  # places whose rows are still equal to others
        if not len(open_):
            break
        rows = order[open_]
        order[open_] = rows[np.lexsort((chars[rows, c], group[open_]))]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (chars[order[1:], c] != chars[order[:-1], c])))
        group = np.cumsum(new) - 1
    return order


def padded(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def _sorted(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the length that each place has in common with the one before it."""
    order = multikey_order(np.ascontiguousarray(raw).view(">u8").astype(np.uint64))
    common_ = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 8192):
        a = order[i - 1 : i + 8191]
        differ = raw[a[1:]] != raw[a[:-1]]
        common_[i : i + len(a) - 1] = np.where(differ.any(1), differ.argmax(1), raw.shape[1])
    return order, common_


def shared_spans(lead: list[bytes], rest: list[bytes], n: np.ndarray) -> np.ndarray:
    """For rows of one bucket: bit o set if the span that starts o bytes before the anchor occurs twice; n counts each row."""
    w = SHAPE.window
    reach = np.array([len(x) for x in rest])
    back = np.array([len(x) for x in lead])
    offsets = np.arange(w)[None]
    valid = (back[:, None] >= offsets) & (reach[:, None] >= SPAN - offsets)
    bits = valid & (n > 1)[:, None]  # equal surroundings, counted before
    forward, f_common = _sorted(padded(rest, SPAN))
    # only suffixes with the same leading bytes as a neighbour can share more
    group = np.cumsum(f_common < SHAPE.prefix)
    alike = np.bincount(group)[group] > 1
    rows = forward[alike]
    if len(rows):
        m, f_common = len(rows), f_common[alike]
        f_common[0] = 0
        f_group, b_group = np.arange(m), np.zeros(m, np.int64)
        backward, b_common = _sorted(padded([lead[i][::-1] for i in rows], w))
        weight, some = n[rows], valid[rows]
        for o in range(w):
            f_group = np.cumsum(f_common < SPAN - o)
            b_group[backward] = np.cumsum(b_common < o)
            take = np.flatnonzero(some[:, o])
            both = f_group[take] * (m + 1) + b_group[take]
            order = np.argsort(both, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], both[order][1:] != both[order][:-1]))) if len(take) else order
            if len(take):
                total = np.add.reduceat(weight[take][order], starts)
                size = np.diff(np.append(starts, len(take)))
                bits[rows[take[order]], o] = np.repeat(total, size) > 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _inner(batches):
    for rows in repeats.parts(batches, ["key", "ctx", "n", "lead", "rest"]):
        masks = shared_spans(rows["lead"], rows["rest"], rows["n"])
        some = masks.any(1)
        yield pa.RecordBatch.from_arrays([pa.array(rows["key"][some]), pa.array(rows["ctx"][some]), pa.array(masks[some, 0]), pa.array(masks[some, 1])], names=["key", "ctx", "m0", "m1"])


def trim(lead: bytes, rest: bytes, low: int, high: int) -> tuple[bytes, bytes, bytes] | None:
    """Of the spans that start low to high before the anchor: the bytes before it and from it on that they cover, and those that all of them cover."""
    first, last = max(low, SPAN - len(rest)), min(high, len(lead))
    if first > last:
        return None
    return lead[len(lead) - last :], rest[: SPAN - first], lead[len(lead) - low :] + rest[: SPAN - high]


def _whole_masks():
    """m0, m1: all spans that ``lead`` and ``rest`` have room for."""
    first, last = F.greatest(F.lit(0), SPAN - F.octet_length("rest")), F.least(F.lit(SHAPE.window - 1), F.octet_length("lead"))
    out = []
    for low in (0, 64):
        a, b = F.greatest(first - low, F.lit(0)), F.least(last - low, F.lit(63))
        ones = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - (b - a)), a)
        out.append(F.when(a <= b, ones).otherwise(F.lit(0).cast("long")).alias(f"m{low // 64}"))
    return out


def splitters(docs: DataFrame, found: DataFrame, buckets: int) -> list[bytes]:
    """Leading bytes that part the suffixes into about equal ranges, from a bounded sample."""
    some = found.orderBy(F.xxhash64("rid", "pos"), "rid", "pos").limit(SAMPLE).select("rid", "pos")
    heads = docs.select("rid", "body").join(F.broadcast(some), "rid").select(F.expr(f"substring(body, pos + 1, {SHAPE.prefix})").alias("head"))
    heads = sorted(bytes(r["head"]) for r in heads.collect())
    return sorted({heads[len(heads) * i // buckets] for i in range(1, buckets)}) if heads else []


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, marks): per document the anchors with repeated spans, as array of (pos, m0, m1). docs: rid, doc_id, body."""
    found = repeats.candidates(docs.withColumn("doc_id", F.lit(None).cast("long")), SHAPE, symbols)  # ids don't matter here
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = splitters(docs, found, buckets)

    def bucket(rest: bytes) -> int:
        return bisect_right(bounds, rest[: SHAPE.prefix])

    stand, any_many = repeats.standing(found, HOT)
    rows = repeats.surroundings(docs, stand, extract, bucket)
    own, marked = rows.filter("not many").select(*repeats.KIND, "bucket"), None
    if any_many:
        many = common.cut(rows.filter("many").select(*repeats.KIND))
        split, equal = repeats.refined(many, SHAPE.window, HOT, trim)
        own = own.unionByName(split.withColumn("bucket", F.pmod("part", F.lit(buckets)).cast("int")))
        marked = equal.select("key", "ctx", *_whole_masks()).unionByName(many.filter("n > 1").select("key", "ctx", *_whole_masks()))
    inner = own.repartitionById(buckets, "bucket").sortWithinPartitions("part").mapInArrow(_inner, "key long, ctx long, m0 long, m1 long")
    if marked is not None:
        inner = inner.unionByName(marked).groupBy("key", "ctx").agg(F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1"))
    marks = found.select("rid", "pos", "key", "ctx").join(inner.hint("shuffle_hash"), ["key", "ctx"])
    return marks.groupBy("rid").agg(F.collect_list(F.struct("pos", "m0", "m1")).alias("marks"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rid, doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    source = common.keyed(docs, id_col, text_col)
    both = repeats.joined(source, repeated_spans(source), "marks", "left")

    def run(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for body, own in zip((b.as_py() for b in batch.column("body")), batch.column("marks"), strict=True):
                gone, runs, left = 0, 0, body
                if own.is_valid:
                    flat = own.values
                    masks = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("m0", "m1")], 1)
                    cover = repeats.covered(repeats.starts_of(flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), masks), SPAN, len(body))
                    gone, runs = int(cover.sum()), int((cover[1:] & ~cover[:-1]).sum() + cover[0])
                    left = np.frombuffer(body, np.uint8)[~cover].tobytes()
                sizes.append(len(body))
                removed.append(gone)
                spans.append(runs)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: sizes and the digest of what is kept of every document."""
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
