"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch that have not been counted before are laid out end to end as one
array of symbols with a row number each. In every round all rows apply their pair of
lowest rank at once, at all of its places from the left; rows without a pair are done,
and the symbols that survive are counted. A pre-token of more than ``LONG`` characters is
merged by itself, in rounds that touch only the places of the pair. Counts of pre-tokens
are kept between batches, up to ``KEEP`` of them. The vocabulary (a few hundred kilobytes) travels with the task.

Defined results: null and empty texts have no tokens; special strings inside texts count
as one token each, as the library does by default; repeated rows count alike; very long
texts are read in runs of ``RUN`` pre-tokens; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pre-token pattern of byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEP, RUN, CHARS = 200_000, 100_000, 1 << 20
#: Characters from which a pre-token is merged by itself.
LONG = 1_000
LIMIT = 512


def byte_chars() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + spare)
            spare += 1
    return [out[b] for b in range(256)]


@dataclass
class Vocabulary:
    first: np.ndarray  # symbol of each byte
    pairs: np.ndarray  # left << 32 | right, sorted
    rank: np.ndarray
    merged: np.ndarray
    special: list[str]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        merged = np.array([ids[a + b] for a, b in merges], np.int64)
        return cls(np.array([ids[c] for c in byte_chars()], np.int64), pairs[order], order.astype(np.int64), merged[order], [t["content"] for t in spec.get("added_tokens", [])])

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty piece."""
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done = np.zeros(len(pieces), np.int64)
        none = len(self.rank)
        while len(sym) > 1:
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), none - 1)
            rank = np.where((self.pairs[at] == pair) & (row[:-1] == row[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            live = least < none
            if not live.all():  # rows without a pair are done
                done[row[starts[~live]]] = size[~live]
                if not live.any():
                    return done
                keep = np.repeat(live, size)
                sym, row, rank = sym[keep], row[keep], rank[keep]
                least, size = least[live], size[live]
                at = np.append(at, 0)[keep]
            else:
                at = np.append(at, 0)
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # in a run of places that overlap (a pair of equal symbols) every second one counts
            new = np.concatenate(([True], np.diff(hit) > 1))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = self.merged[at[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, row = sym[stay], row[stay]
        if len(sym):
            done[row[0]] = len(sym)
        return done


    def count_long(self, piece: bytes) -> int:
        """Symbols that survive in one long piece: the same rounds, each of which touches only the places of its pair."""
        sym, n, none = self.first[np.frombuffer(piece, np.uint8)].copy(), len(piece), len(self.rank)
        by_rank = np.empty(none, np.int64)
        by_rank[self.rank] = self.merged
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks, alive = np.full(n, none), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}  # places by the rank of the pair that begins there
        todo: list[int] = []

        def look(places):
            pair = sym[places] << 32 | sym[after[places]]
            at = np.minimum(np.searchsorted(self.pairs, pair), none - 1)
            ranks[places] = np.where(self.pairs[at] == pair, self.rank[at], none)
            places = places[ranks[places] < none]
            places = places[np.argsort(ranks[places], kind="stable")]
            found, start = np.unique(ranks[places], return_index=True)
            for r, some in zip(found.tolist(), np.split(places, start[1:]), strict=True) if len(found) else ():
                if r not in waiting:
                    waiting[r] = []
                    heappush(todo, r)
                waiting[r].append(some)

        look(np.arange(n - 1))
        while todo:
            r = heappop(todo)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (ranks[at] == r)]
            if not len(at):
                continue
            # in a run of places that overlap (a pair of equal symbols) every second one counts
            new = np.concatenate(([True], after[at[:-1]] != at[1:]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            sym[at], alive[gone], ranks[gone], ranks[at] = by_rank[r], False, none, none
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left = before[at]
            look(np.unique(np.concatenate((at[inner], left[left >= 0]))))
        return int(alive.sum())


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pattern = vocabulary, regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.known: dict[str, int] = {}

    def _learn(self, found: set[str]) -> None:
        new = list(found - self.known.keys())
        if new:
            if len(self.known) + len(new) > KEEP:
                self.known = {}
                new = list(found)
            short, long = [p for p in new if len(p) <= LONG], [p for p in new if len(p) > LONG]
            if short:
                self.known.update(zip(short, self.vocabulary.count([p.encode() for p in short]).tolist(), strict=True))
            self.known.update((p, self.vocabulary.count_long(p.encode())) for p in long)

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None:
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > CHARS:
                out += self._flush(held)
                held, size = [], 0
                out.append(self._long(text))
                continue
            held.append(text)
            size += len(text)
            if size > CHARS:
                out += self._flush(held)
                held, size = [], 0
        return out + self._flush(held)

    def _flush(self, texts: list[str]) -> list[int]:
        split = [self._pieces(t) for t in texts]
        found = [[w for p in parts for w in self.pattern.findall(p)] for parts, _ in split]
        self._learn({w for ws in found for w in ws})
        look = self.known.__getitem__
        return [n + sum(map(look, ws)) for ws, (_, n) in zip(found, split, strict=True)]

    def _long(self, text: str) -> int:
        parts, total = self._pieces(text)
        for part in parts:
            words = (m.group() for m in self.pattern.finditer(part))
            while run := list(islice(words, RUN)):
                self._learn(set(run))
                total += sum(map(self.known.__getitem__, run))
        return total


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rid, doc_id, n_bytes, n_tokens. path: a ``.json`` vocabulary of byte-level BPE, read by the driver."""
    vocabulary = Vocabulary.load(path)

    def run(batches):
        counter = Counter(vocabulary)
        for batch in batches:
            n = counter.counts(batch.column("body").cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["rid", "doc_id", "n_bytes", "n_tokens"])

    source = common.keyed(docs, id_col, text_col)
    source = source.select("rid", "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.col("body").cast("string").alias("body"))
    return source.mapInArrow(run, "rid long, doc_id long, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: bytes, tokens and whether they exceed the limit, for every document."""
    import public_tokenizers

    out = count_tokens(common.table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
