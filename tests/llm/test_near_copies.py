import os
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import common
from fieldspark.llm import ngram_jaccard as J
from fieldspark.llm.common import lean, may_be_in, written
from fieldspark.llm.components import components


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = (rng.choice(texts) or "").split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(rng.choice(["", "   ", "a", "A B", "one two three"]))
        else:
            texts.append(" ".join(rng.choices(vocab, k=rng.choice([3, 8, 20, 60, 150]))))
    return texts


def groups(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(
    "name,more",
    [("plain", {}), ("by signature", {"unit_sets": 3}), ("by blocks", {"unit_sets": 2, "unit_shingles": 150}), ("hot in a batch", {"batch_hot": 1, "unit_sets": 5}), ("hot bucket", {"bucket_sets": 2, "unit_shingles": 500}), ("small batches", {"batch_sigs": 1, "batch_rows": 7, "bucket_sigs": 10})],
)
def test_every_way_gives_the_same_exact_groups(make, name, more):
    texts = corpus(3)
    got = groups(J.ngram_jaccard_groups(make(texts), J.JaccardParams(**more)))
    assert got == brute.jaccard_groups(list(enumerate(texts)), 4, 85, 100)


@pytest.mark.parametrize("words,num", [(5, 80), (1, 60), (2, 95)])
def test_other_parameters(make, words, num):
    texts = corpus(words, 80)
    got = groups(J.ngram_jaccard_groups(make(texts), J.JaccardParams(words=words, num=num)))
    assert got == brute.jaccard_groups(list(enumerate(texts)), words, num, 100)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    p = J.JaccardParams()
    for n in list(range(1, 60)) + [100, 300, 1000]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            most = p.most_different(2 * len(a))
            out = rng.integers(0, most // 2 + 1)
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 63, most // 2 - out + out // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if p.den * both >= p.num * (len(a) + len(b) - both):
                assert set(J.signatures(a, p)) & set(J.signatures(b, p))
            far = int(np.bitwise_count(J.fold(J.sketch(a), 8) ^ J.fold(J.sketch(b), 8)).sum())
            assert far <= len(a) + len(b) - 2 * both


def test_nulls_repeats_and_empty(make, spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = make([None, "", long, long, long.upper(), None, long], ids=[0, 1, 5, 4, 9, None, 4])
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_jaccard_groups(df).collect()]
    assert sorted(rows, key=str) == sorted([(0, 0, 0), (1, 0, 1), (5, 37, 4), (4, 37, 4), (4, 37, 4), (9, 37, 4), (None, 0, None)], key=str)
    assert J.ngram_jaccard_groups(df.where("false")).count() == 0
    kept = J.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, 1, 4, None]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    expect = {x: find(x) for x in root}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expect
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_small_table(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert groups(J.ngram_jaccard_groups(docs)) == brute.jaccard_groups(rows, 4, 85, 100)
    assert docs.count() == J.ngram_jaccard_groups(docs.withColumn("sig", F.lit(1))).count()


def test_subsets_are_enumerated():
    """Every window that allows differences enumerates subsets of second-level partitions, and any k differences leave one signature."""
    rng = np.random.default_rng(1)
    for p in (J.JaccardParams(), J.JaccardParams(words=5, num=80), J.JaccardParams(num=60)):
        for n in (5, 12, 30, 70, 150, 400, 900):
            for w in p.windows(n):
                ways = w.subsets()
                assert len(ways) == len(set(ways)) and all(len(x) == w.second - w.differ for x in ways)
                assert (w.differ, w.second, ways) == (0, 1, [(0,)]) or (len(ways) >= 3 and w.second > w.differ + 1)
            # differences spread as evenly over the domain as can be, the worst case of partitioning
            a = (np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n)) + rng.integers(0, 1000, n).astype(np.uint64)
            k = p.most_different(2 * n) // 2
            b = a.copy()
            b[rng.permutation(n)[:k]] ^= np.uint64(1)
            both = len(np.intersect1d(a, b))
            if p.den * both >= p.num * (2 * n - both):
                assert set(J.signatures(a, p)) & set(J.signatures(np.unique(b), p))


def test_one_row_of_each_group_stays(make):
    t = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    near = t[0] + " more"
    df = make([t[0], t[0], t[0], near, t[1], t[1], t[2], t[2], "", "", None], ids=[1, 1, 2, 1, None, None, 7, 7, 3, 3, 3])
    df = df.withColumn("_row", df.n).withColumn("_rk", df.doc_id).withColumn("stays", df.n).withColumn("_root", df.n)
    kept = J.keep_one_of_each(df)
    assert kept.columns == df.columns
    rows = [(r["doc_id"], (r["text"] or "")[:2], r["_rk"], r["_row"]) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted([(1, "a0", 1, "k"), (None, "b0", None, "k"), (7, "c0", 7, "k"), (3, "", 3, "k"), (3, "", 3, "k"), (3, "", 3, "k")], key=str)
    assert J.keep_one_of_each(df.where("false")).count() == 0


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 400)] + [(399, 500 + i) for i in range(200)] + [(900, 901), (901, 902)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for e in edges[:-2] for i in e} | {900: 900, 901: 900, 902: 900}


def test_shuffle_files_go_once_a_table_is_written(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    out = written(spark.range(2000).groupBy((F.col("id") % 700).alias("k")).count().repartition(3, "count"))
    assert not files() - before and spark.conf.get(key) == setting
    assert out.count() == 700


def test_lean_passes_give_the_same_rows():
    batches = [pa.RecordBatch.from_pydict({"a": [i, i + 1]}) for i in range(3)]
    assert list(lean(lambda b: (x for x in b))(iter(batches))) == batches


def test_signatures_take_half_a_key_and_their_owner():
    rng = np.random.default_rng(1)
    key, owner = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64), rng.choice(rng.integers(0, 1 << 64, 5000, dtype=np.uint64), 60_000)
    for n_buckets in (1, 7, 2400):
        bucket = (key % np.uint64(n_buckets)).astype(np.int64)
        hot = (key % np.uint64(11) == 0).astype(np.uint8)
        rows = list(J.pack_signatures(bucket, key, owner, hot))
        got = [(b, *r) for b, n, blob in rows for r in zip(*J.unpack_signatures(n, blob), strict=True)]
        assert sorted(got) == sorted(zip(bucket, key >> np.uint64(32), owner, hot, strict=True))
    # in many small buckets: 4 bytes of the key, 8 of the owner, 2 of its number, and the flag
    assert sum(len(blob) for *_, blob in rows) <= 16 * len(key)


def test_a_group_comes_once_of_each_bucket():
    # signatures 0 to 99 shared by sets 1 and 2, 100 by 1 and 3, 101 by 1, 2 and 3
    key = np.repeat(np.arange(102, dtype=np.uint64), [2] * 101 + [3]) << np.uint64(32)
    owner = np.array([1, 2] * 100 + [1, 3] + [1, 2, 3], np.uint64)
    (_, n, blob), = J.pack_signatures(np.zeros(len(key), np.int64), key, owner, np.zeros(len(key), np.uint8))
    for p in (J.JaccardParams(), J.JaccardParams(bucket_sigs=50)):
        got = list(J._bucket_pass(p)(iter([J._packed_batch([(0, J.SIG, n, blob)])])))
        rows = [(r["a"], r["b"]) for batch in got for r in batch.to_pylist() if r["kind"] == J.MULTI]
        members = {frozenset(b for a, b in rows if a == g) for g, _ in rows}
        assert members == {frozenset(x) for x in ((1, 2), (1, 3), (1, 2, 3))}
        # ranges of one bucket agree on a group's number
        assert len({a for a, _ in rows}) == 3 and len(rows) <= 7 * (1 + len(key) // p.bucket_sigs)


def test_rows_that_are_none_of_a_few(spark, monkeypatch):
    rows = spark.range(4000).select("id", *[c.alias(k) for c, k in zip((F.xxhash64("id"), F.xxhash64("id", "id")), common.ROW, strict=True)])
    few = rows.where("id % 40 = 0")
    for bits in (64, 1 << 10, 1 << 22):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = {r["id"]: r["_may"] for r in may_be_in(rows, few).collect()}
        assert len(got) == 4000 and all(got[i] for i in range(0, 4000, 40))
    assert sum(got.values()) < 110 and may_be_in(rows, few).columns == [*rows.columns, "_may"]
    assert not any(r["_may"] for r in may_be_in(rows, few.where("false")).collect())


def test_texts_of_sets_that_are_not_wanted_are_not_shuffled(make, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(J, "may_be_in", lambda rows, few: seen.append(may_be_in(rows, few)) or seen[-1])
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(300)]
    texts += [t + " more" for t in texts[:5]]
    kept = J.keep_one_of_each(make(texts))
    assert kept.count() == 300 and len(seen) == 2
    assert [s.where("_may").count() for s in seen] == [10, 5]
