import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import chat, language_id, queries
from fieldspark.llm import cross_polytope as A
from fieldspark.llm.common import written


def vectors(spark, x, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, query string")


def exact(x, q, k):
    s = x @ x[q]
    order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))
    return order[:k], s


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32).astype(float) * rng.uniform(0.8, 1.2, (3000, 1)).astype(np.float32)
    x = x.astype(np.float32).astype(float)
    rows = A.nearest_neighbours(vectors(spark, x)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    hit = 0
    for q, got in by.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        top, s = exact(x, q, 20)
        hit += len(set(top) & {r["vec_id"] for r in got})
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in got)
        assert all((a["score"], -a["vec_id"]) > (b["score"], -b["vec_id"]) for a, b in zip(got[:-1], got[1:], strict=True))
    assert hit / (20 * len(by)) >= 0.9


def recall(spark, x, every, k=20):
    """Share of the exact neighbours found, and the queries answered."""
    by = {}
    for r in A.nearest_neighbours(vectors(spark, x), A.AnnParams(k=k), every).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(set(exact(x, q, k)[0]) & got) for q, got in by.items()) / (k * len(by)), sorted(by)


@pytest.mark.parametrize("case", ["128-d", "384-d", "one long", "some long", "lognormal"])
def test_recall_in_many_dimensions_and_on_skewed_norms(spark, case):
    rng = np.random.default_rng(3)
    n, d = {"128-d": (5000, 128), "384-d": (2500, 384)}.get(case, (6000, 64))
    x = rng.normal(size=(n, d))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if case == "one long":
        x[7] *= 3
    if case == "some long":
        x[rng.random(n) < 0.01] *= 5
    if case == "lognormal":
        x *= np.exp(0.5 * rng.normal(size=(n, 1)))
    share, asked = recall(spark, x.astype(np.float32).astype(float), 50)
    assert asked == list(range(0, n, 50)) and share >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_tables_are_hashed(spark, monkeypatch, sf):
    made, probe_pass = [], A._probe_pass
    monkeypatch.setattr(A, "_probe_pass", lambda *a: made.append(a) or probe_pass(*a))
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
    x = np.array([table[i] for i in range(len(table))], float)
    share, asked = recall(spark, x, 20)
    assert made and asked == list(range(0, len(x), 20)) and share >= 0.9


def test_norms_of_any_size(spark):
    x = np.random.default_rng(4).normal(size=(2100, 8)) * np.array([1e-30, 1e-3, 1e3, 1e30])[np.arange(2100) % 4][:, None]
    share, asked = recall(spark, x.astype(np.float32).astype(float), 300, 5)
    assert asked == list(range(0, 2100, 300)) and share >= 0.9


def test_small_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    # all queries are in the fitting sample, so a target of 1 makes the search exact
    for p in (A.AnnParams(k=5, target=1.0), A.AnnParams(k=5, block=16, target=1.0), A.AnnParams(k=5, bucket=1, block=8, target=1.0)):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in A.nearest_neighbours(vectors(spark, x), p).collect()}
        assert got == {(q, i + 1): v for q in range(0, 300, 20) for i, v in enumerate(exact(x, q, 5)[0])}


@pytest.mark.parametrize("clustered", [True, False])
def test_longer_hashes_keep_the_recall(spark, clustered):
    """With buckets of 16 vectors the hash has two axes; probes are fitted, and clustered tables need few of them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 24))
    if clustered:
        x = rng.normal(size=(200, 24))[rng.integers(0, 200, 6000)] + 0.1 * x
    x = x.astype(np.float32).astype(float)
    p = A.AnnParams(bucket=16)
    assert A.second_axes(6000, 24, p) > 1 and A.second_axes(6000, 24, A.AnnParams()) == 1
    made, fit = [], A.fitted_probes
    A.fitted_probes = lambda *a: made.append((fit(*a), a[2])) or made[-1][0]
    try:
        rows = A.nearest_neighbours(vectors(spark, x), p, 40).collect()
    finally:
        A.fitted_probes = fit
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    share = sum(len(set(exact(x, q, 20)[0]) & g) for q, g in got.items()) / (20 * len(got))
    assert sorted(got) == list(range(0, 6000, 40)) and share >= 0.9
    probes, counts = made[0]
    work = sum(probes[b] * n for b, n in counts.items()) / (6000 * 64 * A.second_axes(6000, 24, p))
    assert not clustered or work < 0.1


def test_fitted_probes_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(30):
        band, place = rng.integers(0, 2, 12), rng.integers(0, 6, 12)
        counts = {0: int(rng.integers(1, 50)), 1: int(rng.integers(1, 50))}
        got = A.fitted_probes(place, band, counts, 6, 0.8)
        found = lambda a: sum(place[i] < a[band[i]] for i in range(12))  # noqa: E731, B023
        cost = lambda a: sum(a[b] * n for b, n in counts.items())  # noqa: E731, B023
        assert found(got) >= 10
        # no other choice finds as many for less
        assert all(cost({0: a, 1: b}) >= cost(got) for a in range(1, 7) for b in range(1, 7) if found({0: a, 1: b}) >= found(got))


def test_one_vector_very_often(spark):
    x = np.random.default_rng(8).normal(size=(900, 8))
    x[::3] = x[0]
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in A.nearest_neighbours(vectors(spark, x), A.AnnParams(k=4, block=32), 100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [v for _, v in sorted(got[0])] == [3, 6, 9, 12] and [v for _, v in sorted(got[300])] == [0, 3, 6, 9]


def test_odd_vectors(spark):
    ok = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], [-1.0, 0.0]]
    odd = [None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0], []]
    df = vectors(spark, ok + odd, [0, 3, 2, 5, 20, 40, 60, 80, 100, 120, 140])
    rows = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in A.nearest_neighbours(df).collect()]
    assert sorted(rows) == [(0, 1, 3, 1.0), (0, 2, 2, 0.5), (0, 3, 5, -1.0)]
    assert A.nearest_neighbours(df.where("false")).count() == 0
    assert A.nearest_neighbours(df.where("vec_id = 0")).count() == 0


def test_hadamard_is_orthonormal():
    h = A.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 0, None, "who"), (1, 70, "bob", "späte"), (1, None, "bob", "?")]
    df = spark.createDataFrame([(*t, 9, 9) for t in turns], "conv_id long, turn long, role string, text string, speaker int, block int")
    rows = {(r["conv_id"], r["speaker"]): r for r in chat.rotate_perspectives(df).collect()}
    assert set(rows) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = rows[1, "ann"]
    bob_said = "<|im_start|>user name=bob\n{}<|im_end|>\n".format
    assert ann["rendered"] == bob_said("?") + "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n" + bob_said("hello") + "<|im_start|>assistant\n<|im_end|>\n" + bob_said("späte")
    assert [ann["rendered"][s["start"] : s["start"] + s["length"]] for s in ann["spans"]] == ["hi", ""]
    bob = rows[1, "bob"]
    assert [bob["rendered"][s["start"] : s["start"] + s["length"]] for s in bob["spans"]] == ["?", "hello", "späte"] and bob["n_turns"] == 6
    assert chat.rotate_perspectives(df.where("false")).count() == 0


def test_a_long_dialogue_is_whole(spark):
    turns = [(1, i, "system" if i == 0 else f"p{i % 3}", "be kind" if i == 0 else f"turn {i}") for i in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for p in (chat.ChatParams(), chat.ChatParams(block=7)):
        rows = {r["speaker"]: r for r in chat.rotate_perspectives(df, p).collect()}
        assert set(rows) == {"p0", "p1", "p2"}
        for who, r in rows.items():
            name = lambda x: "system" if x == "system" else "assistant" if x == who else f"user name={x}"  # noqa: B023, E731
            assert r["rendered"] == "".join(f"<|im_start|>{name(x)}\n{t}<|im_end|>\n" for _, _, x, t in turns)
            assert [r["rendered"][s["start"] : s["start"] + s["length"]] for s in r["spans"]] == [t for _, _, x, t in turns if x == who]
            assert (r["n_turns"], r["n_chars"], r["n_target_turns"]) == (200, len(r["rendered"]), len(r["spans"]))


def test_rotation_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    cols = ["conv_id", "speaker", "rendered", "n_turns", "n_target_turns", "n_chars", "target_chars", "spans"]
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    sql = con.execute(f"select {', '.join(cols)} from ({queries.OP10_SQL})").fetchall()
    got = [tuple(r) for r in queries.op10_perspective_rotation(spark, d).select(*cols).collect()]
    assert sorted(got) == sorted(sql)


def test_pipeline_equals_brute_force(spark, sample):
    import brute
    import public_tokenizers as P

    from fieldspark.llm import packing

    docs = spark.read.parquet(f"{sample}/documents.parquet")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sample).persist()
        steps[name] = now
    names = list(steps)
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "suffix_array_dedup", "best_fit_packing"]
    for name in names[:-1]:
        assert steps[name].columns == docs.columns and [f.dataType for f in steps[name].schema] == [f.dataType for f in docs.schema]
    rows = {n: {r["doc_id"]: r for r in steps[n].collect()} for n in names[:-1]}
    # language: every document with letters, since none of this table scores so low
    lettered = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert set(rows["language_id"]) == lettered
    # lines: spread over ten sites, first copy kept
    spread, first = {}, {}
    for i in sorted(rows["language_id"]):
        r = rows["language_id"][i]
        for pos, line in enumerate(r["text"].split("\n")):
            k = line.strip(" \t\r\x0b\x0c")
            if k:
                spread.setdefault(k, set()).add(r["source"])
                first.setdefault(k, (i, pos))
    for i, r in rows["language_id"].items():
        kept = [x for pos, x in enumerate(r["text"].split("\n")) if len(spread.get(k := x.strip(" \t\r\x0b\x0c"), ())) < 10 or first[k] == (i, pos)]
        assert rows["line_dedup"][i]["text"] == "\n".join(kept)
    # near copies: one of each group
    groups = brute.jaccard_groups([(i, r["text"]) for i, r in sorted(rows["line_dedup"].items())], 5, 80, 100)
    assert set(rows["ngram_jaccard"]) == {i for i, (_, root) in groups.items() if i == root}
    # passages: all but the first copy
    order = sorted(rows["ngram_jaccard"])
    plain = [rows["ngram_jaccard"][i]["text"].encode() for i in order]
    for i, b, mask in zip(order, plain, brute.repeat_masks(plain, 200, "first"), strict=True):
        left = bytes(x for x, gone in zip(b, mask, strict=True) if not gone).decode(errors="ignore")
        got = rows["suffix_array_dedup"][i]
        assert got["n_chars"] == len(got["text"]) and abs(len(got["text"]) - len(left)) <= 2 * sum(mask)
        if not any(mask):
            assert got["text"] == rows["ngram_jaccard"][i]["text"]
    # packing: all tokens of what is left
    enc = packing.byte_level_encoding(P.path("byte_bpe_50k.json"))
    total = sum(len(enc.encode(r["text"], allowed_special="all")) + 1 for r in rows["suffix_array_dedup"].values())
    assert sum(r["length"] for r in steps["best_fit_packing"].collect()) == total
    assert steps["best_fit_packing"].count() == corpus_pipeline.run(spark, sample).count()


def test_stages_with_odd_rows(spark, make):
    """Nulls, repeated rows and ids, clashing columns: every stage keeps the columns, one copy of each document stays whole."""
    rng = np.random.default_rng(7)
    say = lambda n: " ".join(rng.choice(["wald", "haus", "berg", "see", "weg", "stein", "bach", "feld"], n)) + f" ende{rng.integers(1 << 40)}"
    a, b, c = say(120), say(120), say(150)
    texts = [a, a, a, b, b, c, c[:-40], None, "", "12 34", "start " + b[200:500] + " " + say(60)]
    docs = make(texts, ids=[1, 1, 2, None, None, 3, 4, 5, 6, 7, 8])
    for name in ("score", "lang_pred", "n_lines", "_rk", "_row", "_rest", "_text", "c0", "unit"):
        docs = docs.withColumn(name, F.col("text"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, ""), name)
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.where("false"), "").count() == 0
    rows = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str)
    assert [i for i, _ in rows] == [1, 3, 8, None]
    left = dict(rows)
    # null ids come before all others, so the null row keeps the passage it shares with 8
    assert left[1] == a and left[None] == b and left[3] == c and b[210:490] not in left[8]
    assert all(r["score"] == r["n_lines"] == r["c0"] and r["score"] in (a, b, c, texts[-1]) for r in now.collect())
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, "").where("length > 1").count() > 0 and last(spark, docs.where("false"), "").count() == 0


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)
