"""The corpus pipeline from end to end, and every stage of it, against what was planted."""

import hashlib
import math
import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(8)
    plain, rude = [f"{a}{b}" for a in ("tree", "house", "river", "stone", "cloud", "market") for b in range(60)], ["grotzer", "grotzel", "blaffig", "snurke"]
    text = lambda n=60: [r.choice(plain) for _ in range(n)]
    passage, rows, kind = text(12), [], {}

    def add(what, words, source):
        kind[len(rows)] = what
        rows.append((len(rows), words if words is None or isinstance(words, str) else " ".join(words), "en", source, 1))
        return len(rows) - 1

    labels, pairs, copies = [], [], []
    for k in range(360):
        words = text()
        if k % 6 == 0:
            words[r.randint(0, 29)], words[r.randint(30, 59)] = r.sample(rude, 2)
        i = add("toxic" if k % 6 == 0 else "clean", words, "hot" if k % 3 else "rare")
        labels.append((i, 1, int(k % 6 == 0)))
    for i in (1, 7, 13):
        copies.append((i, add("clean", rows[i][1].replace("tree", "Tree"), rows[i][3])))
    for i in (2, 8, 14, 20):
        words = rows[i][1].split()
        pairs.append((i, add("near", [*words[:30], "changed", *words[31:]], rows[i][3])))
    leaks = {add("leak", [*text(20), *passage, *text(20)], None) for _ in range(4)}
    empty = add("empty", None, None)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, kind, copies, pairs, leaks, empty


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, planted, tmp_path):
    folder, rows, kind, copies, pairs, leaks, empty = planted
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    want = {i for i, k in kind.items() if k != "toxic"}
    for name, gone in (("toxicity", set()), ("exact_dedup", {a for a, _ in copies}), ("simhash_near_dedup", None), ("benchmark_decontamination", leaks)):
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = ids(docs)
        assert len(got) == len(set(got))
        if gone is None:  # one of each pair stays
            assert all(len(set(p) & set(got)) == 1 for p in pairs)
            gone = {i for p in pairs for i in p} - set(got)
        want -= gone
        assert set(got) == want, name
    assert empty in want


def test_whole_run(spark, planted):
    folder, rows, kind, copies, pairs, leaks, _ = planted
    counts = {}
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"]
    for r in result.collect():
        counts.setdefault(r.doc_id, []).append(r["copy"])
        assert r.text == rows[r.doc_id][1] and r.source == rows[r.doc_id][3]
    either = {i for p in pairs for i in p}
    left = [i for i, k in kind.items() if k != "toxic" and i not in leaks and i not in {a for a, _ in copies} and i not in either]
    size = {}
    for i in [*left, *(a for a, _ in pairs)]:
        size[rows[i][3]] = size.get(rows[i][3], 0) + 1
    total, mass = sum(size.values()), sum(math.sqrt(n) for n in size.values())

    def drawn(i):
        n = size[rows[i][3]]
        mean = round(math.sqrt(n) * total / mass / n, 9)
        pieces, count = max(1, math.ceil(mean / 16)), 0
        for j in range(1, pieces + 1):
            u = int(hashlib.md5(f"17:{i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-mean / pieces)
            for k in range(1, 98):
                count += c <= u
                p *= mean / pieces / k
                c += p
        return count

    for i in left:
        assert sorted(counts.get(i, [])) == list(range(1, drawn(i) + 1)), i
    for a, b in pairs:
        assert not (a in counts and b in counts) and sum(len(counts.get(i, [])) for i in (a, b)) in (drawn(a), drawn(b))
    assert set(counts) <= {*left, *either}


def test_empty_tables(spark, planted, tmp_path):
    folder = planted[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
