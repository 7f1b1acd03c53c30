"""Toxicity by weak supervision: mined lexicons and patterns vote, a label model weighs the votes, a linear classifier learns from its posterior.

1. From the labelled rows that may be learned from, at most ``MAX_LABELLED`` of them
   (those least by a hash of the id), whole texts are read and words and word beginnings
   that occur almost only in toxic texts form lexicons.
2. Voters: a part of a lexicon that occurs votes 1, else abstains; a lexicon of which
   nothing occurs votes -1; surface patterns vote 1.
3. A generative model with a hidden class and a vote distribution per voter and class is
   fitted by EM without labels, from the share of voters that vote 1 on, which also says
   what class 1 is. Correlations of voters given the class are estimated from the
   residuals in every round and discount the evidence of correlated voters.
4. A logistic regression on counts of lexicon hits and patterns is trained on the
   posterior labels; its output is calibrated on the labelled rows.

All documents are scored in one pass without a shuffle. Labels, language, source and id
are no inputs of a score.

Defined results: null texts score as empty ones; labels that are null are ignored and of
several labels of an id the largest counts; without labelled rows of both kinds every
score is 0; repeated rows score alike; null ids are not held out; very long texts are
scored whole, one at a time; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows used for fitting; they bound lexicons and what reaches the driver.
MAX_LABELLED = 20_000
HELD_OUT, FOLDS, THRESHOLD = 2, 4, 0.3
#: Voters into which a lexicon is parted.
PARTS = 8
KINDS = (("word", None), ("five", 5), ("four", 4))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PATTERNS = (re.compile(rb"[A-Z]{4,}!!"), re.compile(rb"([!?*#$%&])\1{2,}"), re.compile(rb"\b[A-Z]{5,}\b[^a-z]{0,3}\b[A-Z]{5,}\b"))


def tokens(body: bytes) -> tuple[set[bytes], ...]:
    """Distinct words, and beginnings of five and four bytes of longer words."""
    words = set(body.translate(FOLD).split())
    return words, {w[:5] for w in words if len(w) > 5}, {w[:4] for w in words if len(w) > 4}


@dataclass
class Lexicons:
    parts: list[list[frozenset[bytes]]]  # kind, part
    whole: list[frozenset[bytes]] = field(default_factory=list)

    def __post_init__(self):
        self.whole = [frozenset().union(*p) for p in self.parts]

    def features(self, body: bytes) -> list[float]:
        out: list[float] = []
        for found, whole, parts in zip(tokens(body), self.whole, self.parts, strict=True):
            hits = found & whole
            out += [float(len(hits & p)) for p in parts] if hits else [0.0] * len(parts)
        return out + [float(p.search(body) is not None) for p in PATTERNS]


def votes(x: np.ndarray) -> np.ndarray:
    """Features to votes: a column per lexicon part, per lexicon (-1 if nothing of it occurs, 1 if two entries do), per pattern."""
    n = len(KINDS) * PARTS
    per_kind = x[:, :n].reshape(len(x), len(KINDS), PARTS).sum(2)
    return np.concatenate([(x[:, :n] > 0).astype(int), np.where(per_kind == 0, -1, np.where(per_kind > 1, 1, 0)), (x[:, n:] > 0).astype(int)], 1)


def label_model(v: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 per row; P(vote | class) per voter; discount per voter."""
    m = v.shape[1]
    post = np.clip((v > 0).sum(1) / np.maximum(1, (v != 0).sum(1)), 0.02, 0.98)
    weight = np.ones(m)
    p = np.zeros((m, 2, 3))
    for _ in range(rounds):
        by = np.stack([1 - post, post], 1)
        prior = np.clip(by.mean(0), 1e-3, 1)
        for k in range(3):
            p[:, :, k] = (v == k - 1).T.astype(float) @ by + 0.5
        p /= p.sum(2, keepdims=True)
        residual = v - sum(by[:, [c]] * (p[:, c] @ np.array([-1.0, 0.0, 1.0]))[None] for c in range(2))
        spread = residual.std(0) + 1e-9
        rho = np.clip(residual.T @ residual / len(v) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + rho.sum(1))
        logs = np.log(p)
        score = np.log(prior)[None] + sum(weight[j] * logs[j][:, v[:, j] + 1].T for j in range(m))
        post = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -40, 40)))
    return post, p, weight


def _inputs(x: np.ndarray) -> np.ndarray:
    n = len(KINDS) * PARTS
    kinds = x[:, :n].reshape(len(x), len(KINDS), PARTS).sum(2)
    return np.concatenate([np.log1p(x), np.log1p(kinds), (kinds > 0).sum(1, keepdims=True) / len(KINDS)], 1)


def logistic(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (bias first) by Newton steps; targets may be probabilities."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-3

    def loss(v):
        z = a @ v
        return np.logaddexp(0, z).sum() - target @ z + 0.5 * ridge @ (v * v)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(ridge), a.T @ (target - q) - ridge * w)
        size, before = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > before:
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicons: Lexicons
    weights: np.ndarray
    scale: tuple[float, float]

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        if not len(self.weights) or not bodies:
            return np.zeros(len(bodies))
        x = _inputs(np.array([self.lexicons.features(b) for b in bodies]))
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * z, -30, 30)))


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on labelled rows outside of the held-out fold."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = common.keyed(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("toxic", "body")
    sample = common.cut(sample.limit(max_labelled))  # an id may have several rows

    def mined(batches):
        for batch in batches:
            kinds, found, toxic = [], [], []
            for body, label in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for k, some in enumerate(tokens(body)):
                    kinds += [k] * len(some)
                    found += some
                    toxic += [label] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(found, pa.binary()), pa.array(toxic, pa.int64())], names=["kind", "token", "toxic"])

    # of equal texts one counts, else what copies have in common looks like a sign
    once = sample.groupBy(F.sha2("body", 256)).agg(F.max(F.struct("toxic", "body")).alias("x")).select("x.toxic", "x.body")
    n, n_toxic = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return Model(Lexicons([[frozenset()] * PARTS for _ in KINDS]), np.zeros(0), (0.0, 1.0))
    least = max(3, round(0.004 * n_toxic))
    ratio = (F.col("toxic") / F.lit(float(n_toxic))) / ((F.col("n") - F.col("toxic") + 0.5) / F.lit(float(n - n_toxic)))
    counts = once.mapInArrow(mined, "kind int, token binary, toxic long").groupBy("kind", "token").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    best = counts.filter((F.col("toxic") >= least) & (ratio >= 40)).orderBy(F.desc("toxic"), "n", "kind", "token").collect()  # of max_labelled texts
    parts = [[set() for _ in range(PARTS)] for _ in KINDS]
    for i, r in enumerate(best):
        parts[r["kind"]][i % PARTS].add(bytes(r["token"]))
    lexicons = Lexicons([[frozenset(p) for p in kind] for kind in parts])

    def measured(batches):
        for batch in batches:
            x = [lexicons.features(body) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(measured, "toxic int, x array<double>").collect()  # at most max_labelled short rows
    y, x = np.array([r["toxic"] for r in rows], float), np.array([r["x"] for r in rows])
    post, _, _ = label_model(votes(x))
    weights = logistic(_inputs(x), post)
    z = weights[0] + _inputs(x) @ weights[1:]
    a, b = logistic(z[:, None], y, penalty=0.1)
    return Model(lexicons, weights, (float(a), float(b)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, score)"""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(model.scores(batch.column("body").to_pylist()), pa.float64())], names=["rid", "doc_id", "score"])

    return common.keyed(docs, id_col, text_col).mapInArrow(run, "rid long, doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: score and verdict of every document."""
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents with a score under the threshold stay; rows are tested where they are."""
    model = fit(docs, common.table(spark, sf_dir, "labels"))

    def run(batches):
        for batch in batches:
            bodies = [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.scores(bodies) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
