"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n documents with target share w of a corpus of N documents has the mean
repetition rate w * N / n. The count of a document is drawn by inverting the Poisson
distribution of that mean at a uniform number hashed from seed and id, the document is
exploded by its count, and all copies are dealt by a hash of (seed, id, copy) and
sorted by it within partitions, which is one global shuffle. Means over ``PIECE`` are
split into equal independent pieces, whose counts add up; each piece is inverted
exactly to the 52 bits of its uniform number.

Defined results: null sources form one source; null ids hash as ``null``; empty texts
count as documents, very long ones as one each; rows that repeat an id get the same count;
an empty table gives no rows; further columns are carried along, but for ``copy`` and
``mix_key``, which the result has of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 17
#: Largest mean that one inversion handles, and the largest count it can yield (chance beyond: under 2**-52).
PIECE, TERMS = 16.0, 96
#: Sources up to which their rates are broadcast (counted first); more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Share of a source in the target: its number of documents to this power.
ALPHA = 0.5


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, source_col: str = "source") -> DataFrame:
    """Per source: key__, pieces__, cdf__ (cumulative probabilities of one piece)."""
    sizes = docs.groupBy(F.col(source_col).alias("source__")).agg(F.count(F.lit(1)).alias("n__"))
    if weights is None:
        sizes = sizes.withColumn("w__", F.pow(F.col("n__").cast("double"), F.lit(alpha)))
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("source__").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
        sizes = sizes.withColumn("w__", w)
    sizes = common.cut(sizes)  # a row per source
    rows, mass = sizes.agg(F.coalesce(F.sum("n__"), F.lit(0)), F.coalesce(F.sum("w__"), F.lit(0.0))).first()
    rate = F.round(F.col("w__") * rows / F.lit(float(mass)) / F.col("n__"), 9) if mass > 0 else F.lit(0.0)
    out = sizes.withColumn("rate__", rate)
    out = out.withColumn("pieces__", F.greatest(F.lit(1), F.ceil(F.col("rate__") / PIECE)).cast("int")).withColumn("mean__", F.col("rate__") / F.col("pieces__"))
    first = F.exp(-F.col("mean__"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def term(acc, k):
        p = acc["p"] * F.col("mean__") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, term, lambda acc: acc["all"])
    return out.select(F.struct(F.col("source__").isNull(), F.coalesce("source__", F.lit(""))).alias("key__"), "pieces__", cdf.alias("cdf__"))


def _bits(text, digits: int):
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` plus ``copy`` (1 up to the document's count) and ``mix_key``; rows in mixed order."""
    per_source = common.cut(rates(docs, weights, alpha, source_col))
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    source, own = F.col(f"`{source_col}`"), [F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "mix_key")]
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    # the columns of docs in one, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*own).alias("row"), name.alias("name__"), F.struct(source.isNull(), F.coalesce(source, F.lit(""))).alias("key__")).join(per_source, "key__")
    u = lambda j: _bits(F.concat(F.lit(f"{seed}:"), F.col("name__"), F.lit(":"), j.cast("string")), 13) / F.lit(float(2**52))
    count = F.aggregate(F.sequence(F.lit(1), F.col("pieces__")), F.lit(0), lambda n, j: n + F.size(F.filter("cdf__", lambda c: c <= u(j))))
    copies = rows.withColumn("count__", count).filter("count__ > 0").select("row", "name__", F.explode(F.sequence(F.lit(1), F.col("count__"))).alias("copy"))
    key = _bits(F.concat(F.lit(f"{seed}:order:"), F.col("name__"), F.lit(":"), F.col("copy").cast("string")), 15)
    keyed = copies.select("row.*", "copy", key.alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the mixed corpus, whole rows."""
    return mix(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


ORACLE = """
with recursive sizes as (select source, count(*) as n, sqrt(count(*)::double) as w from documents group by source),
r as (select source, round(w * (select sum(n) from sizes) / (select sum(w) from sizes) / n, 9) as rate from sizes),
m as (select source, greatest(1, ceil(rate / 16.0))::int as pieces, rate / greatest(1, ceil(rate / 16.0)) as mean from r),
t(source, k, p, c) as (select source, 0, exp(-mean), exp(-mean) from m
  union all select t.source, t.k + 1, t.p * m.mean / (t.k + 1), t.c + t.p * m.mean / (t.k + 1) from t join m on t.source is not distinct from m.source where t.k < 96),
d as (select documents.*, m.pieces from documents join m on documents.source is not distinct from m.source),
u as (select doc_id, source, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null') || ':' || j), 1, 13))::bigint / 4503599627370496.0::double as u
  from (select distinct doc_id, source, unnest(range(1, pieces + 1)) as j from d)),
n as (select u.doc_id, u.source, count(*) as n from u join t on t.source is not distinct from u.source and t.c <= u.u group by u.doc_id, u.source)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, x.copy::int as copy,
  ('0x' || substr(md5('17:order:' || coalesce(d.doc_id::varchar, 'null') || ':' || x.copy), 1, 15))::bigint as mix_key
from d join (select doc_id, source, unnest(range(1, n + 1)) as copy from n) x on x.doc_id is not distinct from d.doc_id and x.source is not distinct from d.source
"""
