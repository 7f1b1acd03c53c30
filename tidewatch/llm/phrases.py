"""Substring dedup over words with repeated-phrase automata.

Every document is streamed once for its anchors (``repeats``); passages around anchors
whose words recur are confirmed by comparing them, and the phrases of ``SPAN`` words that
recur in a shard are compiled into an Aho-Corasick automaton, which all passages of the
shard are streamed through to locate every occurrence. A shard holds the passages that
share the words from an anchor on, so every occurrence of a phrase is streamed through
the automaton that has it, and an automaton's size is bounded (``PHRASES``) whatever the
corpus. Passages with equal surroundings are one passage with the first of its places.
Where more than ``HOT`` kinds of surroundings share an anchor's words, the shard is split
into the phrases that start at most half a window before the anchor and the others, which
have more words in common, again and again (``repeats.refined``); words decide there too.

The first occurrence of a phrase, by (id, row, place), stays; words that another
occurrence covers are removed.

Defined results: null texts have no words; texts under ``SPAN`` words keep all words;
null ids come first; rows that repeat an id follow each other in the order of the scan;
very long texts are handled one at a time; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

SPAN = 20
SHAPE = repeats.Shape(SPAN, 15, 3)
#: Kinds of surroundings of an anchor's words that one shard holds (about 100 MB of a task), and phrases of one automaton (about 40 MB).
HOT, PHRASES = 32_768, 4_000
TABLE = np.random.default_rng(21).integers(0, 2**64, 256, dtype=np.uint64)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_edges(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of concatenated texts; a text's end ends a word."""
    word = ~SPACE[raw]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def symbols(bodies: list[bytes], powers) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
    start, stop = word_edges(raw, bounds)
    values = repeats.mix(repeats.Hashes(TABLE[raw], powers).of(start, stop) + (stop - start).astype(np.uint64))
    return values, np.searchsorted(start, bounds)


def extract(body: bytes, places: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    words, at = body.split(), places.tolist()
    return [b" ".join(words[max(0, p - SHAPE.window + 1) : p]) for p in at], [b" ".join(words[p : p + SPAN]) for p in at]


def spans_of(lead: bytes, rest: bytes) -> list[tuple[int, bytes]]:
    """(o, phrase) of the spans that start o words before the anchor; phrases have a space on either side."""
    before, after = lead.split(), rest.split()
    words, n = before + after, len(before)
    return [(o, b" " + b" ".join(words[n - o : n - o + SPAN]) + b" ") for o in range(min(n, SHAPE.window - 1) + 1) if n - o + SPAN <= len(words)]


def locate(passages: list[tuple[bytes, bytes]], places: list[tuple]) -> list[int]:
    """For passages of a shard: bit o is set if the span that starts o words before the anchor occurs earlier. places: (doc_id, rid, pos) of the first of each."""
    once, twice = set(), set()  # hashes; they only choose the phrases
    for p in passages:
        for _, phrase in spans_of(*p):
            (twice if hash(phrase) in once else once).add(hash(phrase))
    masks = [0] * len(passages)
    recurring = list(dict.fromkeys(phrase for p in passages for _, phrase in spans_of(*p) if hash(phrase) in twice)) if twice else []
    for i in range(0, len(recurring), PHRASES):
        machine = ahocorasick.Automaton()
        some = recurring[i : i + PHRASES]
        for k, phrase in enumerate(some):
            machine.add_word(phrase.decode("latin-1"), k)
        machine.make_automaton()
        first: list[tuple | None] = [None] * len(some)
        found = []
        for row, (lead, rest) in enumerate(passages):
            text = b" " + (lead + b" " + rest if lead else rest) + b" "
            anchor = len(lead.split())
            for end, k in machine.iter(text.decode("latin-1")):
                stop = text.count(b" ", 0, end + 1) - 1  # words up to the phrase's end
                o = anchor - (stop - SPAN)
                doc, rid, pos = places[row]
                place = (doc, rid, pos - o)
                found.append((row, k, o, place))
                if first[k] is None or place < first[k]:
                    first[k] = place
        for row, k, o, place in found:
            if 0 <= o < SHAPE.window and place != first[k]:
                masks[row] |= 1 << o
    return masks


def trim(lead: bytes, rest: bytes, low: int, high: int) -> tuple[bytes, bytes, bytes] | None:
    """Of the phrases that start low to high words before the anchor: the words before it and from it on that they cover, and those that all of them cover."""
    before, after = lead.split(), rest.split()
    first, last = max(low, SPAN - len(after)), min(high, len(before))
    if first > last:
        return None
    return b" ".join(before[len(before) - last :]), b" ".join(after[: SPAN - first]), b" ".join(before[len(before) - low :] + after[: SPAN - high])


def _shards(batches):
    for rows in repeats.parts(batches, ["key", "ctx", "doc_id", "rid", "pos", "lead", "rest"], 1_000):
        places = list(zip(rows["doc_id"].tolist(), rows["rid"].tolist(), rows["pos"].tolist(), strict=True))
        masks = np.array(locate(list(zip(rows["lead"], rows["rest"], strict=True)), places), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows["key"]), pa.array(rows["ctx"]), pa.array(masks)], names=["key", "ctx", "mask"])


def _whole_mask():
    """All phrases that ``lead`` and ``rest`` have room for."""
    words = lambda c: F.when(F.octet_length(c) == 0, 0).otherwise(F.size(F.split(F.col(c).cast("string"), " ")))
    first, last = F.greatest(F.lit(0), SPAN - words("rest")), F.least(F.lit(SHAPE.window - 1), words("lead"))
    return F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), last - first + 1) - 1, first)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, marks): per document the anchors with spans that occur earlier, as array of (pos, mask). docs: rid, doc_id, body."""
    found = repeats.candidates(docs, SHAPE, symbols)
    stand, any_many = repeats.standing(found, HOT)
    stand = common.freed(stand)
    asked = stand.filter("differ")
    some = common.marked(docs, common.bitmap(asked, "rid"), "rid").filter("open").drop("open")  # other texts aren't shuffled
    rows = repeats.surroundings(some, asked, extract)
    own, equal = rows.filter("not many").select(*repeats.KIND), None
    if any_many:
        split, equal = repeats.refined(rows.filter("many").select(*repeats.KIND), SHAPE.window, HOT, trim)
        own = own.unionByName(split)
    masks = own.repartition("part").sortWithinPartitions("part").mapInArrow(_shards, "key long, ctx long, mask long").filter("mask <> 0")
    if equal is not None:
        late = equal.filter(~F.col("first")).select("key", "ctx", _whole_mask().alias("mask"))
        masks = masks.unionByName(late).groupBy("key", "ctx").agg(F.bit_or("mask").alias("mask"))
    masks = common.freed(masks)  # so that texts and passages aren't on disk together with what follows
    # an anchor that is not the first of its surroundings has an earlier occurrence of every span
    mine = stand.select("key", "ctx", F.col("rid").alias("first_rid"), F.col("pos").alias("first_pos"))
    first_of = found.select("rid", "pos", "key", "ctx").join(mine.hint("shuffle_hash"), ["key", "ctx"])
    same = (F.col("rid") == F.col("first_rid")) & (F.col("pos") == F.col("first_pos"))
    marks = first_of.join(masks.hint("shuffle_hash"), ["key", "ctx"], "left").select("rid", "pos", F.when(same, F.coalesce("mask", F.lit(0).cast("long"))).otherwise(F.lit((1 << SHAPE.window) - 1).cast("long")).alias("mask"))
    return common.freed(marks.filter("mask <> 0").groupBy("rid").agg(F.collect_list(F.struct("pos", "mask")).alias("marks")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rid, doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    source = common.keyed(docs, id_col, text_col)
    spans = repeated_spans(source)
    rows = common.marked(source, common.bitmap(spans, "rid"), "rid")
    whole = rows.filter("not open").select("rid", "doc_id", "body", F.lit(None).cast(spans.schema["marks"].dataType).alias("marks"))
    both = repeats.joined(rows.filter("open"), spans, "marks", "left").unionByName(whole)

    def run(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for body, own in zip((b.as_py() for b in batch.column("body")), batch.column("marks"), strict=True):
                words, gone = body.split(), 0
                sizes.append(len(words))
                if own.is_valid:
                    flat = own.values
                    start = repeats.starts_of(flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("mask").to_numpy(zero_copy_only=False)[:, None])
                    cover = repeats.covered(start[(start >= 0) & (start + SPAN <= len(words))], SPAN, len(words))
                    gone = int(cover.sum())
                    words = [words[i] for i in np.flatnonzero(~cover).tolist()]
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["rid", "doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "rid long, doc_id long, n_words long, n_removed long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: words, removed words and the digest of what is kept of every document."""
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
