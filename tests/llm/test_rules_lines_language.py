import random
import tracemalloc

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import cotraining, language_id, line_dedup, quality_rules
from fieldspark.llm.queries import OP6_SQL

ODD = [None, "", " \n\t ", "one", "a\x0bb\x0cc\rd", "#$%& <> ** ||", "same line\nsame line\n\nsame line \nother", "é à ü ß 東京 x\x1fy"]


def test_counts_equal_brute_force():
    rng = random.Random(0)
    texts = ODD + [" ".join(rng.choices("ab cd ef\n gh # \n\n".split(" "), k=rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert quality_rules.text_counts(np.frombuffer((t or "").encode(), np.uint8))[:5] == brute.quality_counts(t)


def test_rules_keep_clean_and_drop_odd_documents(make):
    rng = random.Random(1)
    vocab = ["the", "house", "of", "green", "water", "runs", "over", "stones", "and", "sings"] + [f"word{c}" for c in "abcdefghijklmnopq"]
    clean = [" ".join(rng.choices(vocab, k=120)) + f" tail{i}" for i in range(150)]
    odd = ["&&& ".join(rng.choices(vocab, k=120)) for _ in range(5)]
    docs = make([*clean, *odd, *ODD])
    rows = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(docs).collect()}
    assert len(rows) == docs.count()
    assert all(rows[i]["kept"] for i in range(150)) and not any(rows[i]["kept"] for i in range(150, 155))
    assert all(rows[i]["base_failed"] and not rows[i]["kept"] for i in range(155, 155 + len(ODD)))
    assert quality_rules.apply_quality_rules(docs.where("false")).count() == 0
    null = make(clean[:3], lang=[None] * 3, source=[None, None, "a"], ids=[None, 1, 1])
    assert [r["kept"] for r in quality_rules.apply_quality_rules(null).collect()] == [True] * 3


def test_fences_follow_the_data(spark):
    # the same documents, with ratios scaled per language: every fence scales with them, so no constant decides
    rng = np.random.default_rng(5)
    n, scale = 400, {"a": 1.0, "b": 0.25}
    base = {"word_length": 4 + rng.random(n), "symbol_ratio": 0.02 * rng.random(n), "dup_line_ratio": 0.1 * rng.random(n), "repeat_ratio": 0.1 * rng.random(n)}
    rows = [(lang, f"s{i % 2}", False, *[float(v[i] * s) for v in base.values()]) for lang, s in scale.items() for i in range(n)]
    counts = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, " + ", ".join(f"{m} double" for m in base))
    # sketches that hold all values are exact
    t = {(r["lang"], r["source"]): r for r in quality_rules.group_thresholds(counts, quality_rules.QualityParams(sketch_k=4000)).collect()}
    for source in ("s0", "s1"):
        for m in base:
            a, b = t["a", source][f"{m}_max"], t["b", source][f"{m}_max"]
            assert np.isclose(b, a / 4) and base[m].max() < a < 10 * base[m].max()
        assert np.isclose(t["b", source]["word_length_min"], t["a", source]["word_length_min"] / 4) and t["a", source]["word_length_min"] < 4


def test_every_rule_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    p = quality_rules.QualityParams()
    counts = quality_rules.document_counts(docs, p).where("not base_failed").persist()
    t = quality_rules.group_thresholds(counts, p).drop("n")
    rows = counts.join(t, ["lang", "source"]).collect()
    out = {m: {r["doc_id"] for r in rows if not r[f"{m}_min"] <= r[m] <= r[f"{m}_max"]} for m in quality_rules.METRICS}
    assert all(out.values())
    plain = {r["doc_id"] for r in rows if r["symbol_ratio"] < 0.04}
    assert len(plain & set().union(*out.values())) < 0.01 * len(plain)


def test_a_group_of_copies_does_not_reject_others(make):
    rng = random.Random(6)
    vocab = ["the", "house", "of", "green", "water", "runs", "over", "stones", "and", "sings"] + [f"word{c}" for c in "abcdefghijklmnopq"]
    clean = [" ".join(rng.choices(vocab, k=120)) + f" tail{i}" for i in range(160)]
    docs = make([*clean[:100], *[clean[0]] * 95, *clean[100:105]], source=["a"] * 100 + ["b"] * 100)
    rows = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(docs).collect()}
    assert all(rows[i]["kept"] for i in range(195, 200))


def test_base_rule_at_its_edges(make):
    fifty = " ".join(f"w{i}" for i in range(50))
    half = " ".join(["x y z"] * 2 + [f"v{i}" for i in range(44)])
    rows = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(make([fifty, fifty.rsplit(" ", 1)[0], half, " ".join(["a b c"] * 20)])).collect()}
    assert [rows[i]["base_failed"] for i in range(4)] == [False, True, False, True]


def test_lines_equal_sql(make):
    rng = random.Random(2)
    common = [f"common line {i}" for i in range(8)]
    texts, source = [], []
    for i in range(200):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own {i} {j}" for j in range(rng.randrange(6))]
        texts.append("\n".join(x + rng.choice(["", " ", "\t"]) for x in lines))
        source.append(rng.choice([f"s{k}" for k in range(rng.choice([3, 12, 30]))]))
    docs = make(texts, source=source)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], r["text"]) for r in line_dedup.remove_boilerplate(docs).collect()}
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by name
    sql = {r[0]: (r[1], r[2], r[3]) for r in duckdb.sql(OP6_SQL).fetchall()}
    assert got == sql and sum(v[1] for v in got.values()) > 0


def test_lines_nulls_repeats_and_empty(make):
    docs = make([None, "", "x\ny", "x\ny", "x", "x"], ids=[None, 1, 2, 2, 3, 4], source=["a", "b", "c", "d", None, "e"])
    p = line_dedup.LineParams(min_sites=3)
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in line_dedup.remove_boilerplate(docs, p).collect()]
    assert sorted(got, key=str) == sorted([(None, None, 0, 0), (1, "", 1, 0), (2, "x\ny", 2, 0), (2, "x\ny", 2, 0), (3, "", 1, 1), (4, "", 1, 1)], key=str)
    every = line_dedup.remove_boilerplate(docs, line_dedup.LineParams(min_sites=3, keep_first=False))
    assert {r["text"] for r in every.where("doc_id = 2").collect()} == {"y"}
    assert line_dedup.remove_boilerplate(docs.where("false"), p).count() == 0


def test_lines_and_languages_with_clashing_columns(make):
    docs = make(["x\ny", "x\nz", "x", None], source=["a", "b", "c", "d"])
    for c in ("_rk", "_rk2", "_drop", "_row", "h1", "pos", "site", "first", "_slot", "lang_pred", "score"):
        docs = docs.withColumn(c, F.col("doc_id") + 100)
    docs = docs.withColumn("n_lines", F.lit("mine"))
    out = line_dedup.remove_boilerplate(docs, line_dedup.LineParams(min_sites=3))
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_removed_lines"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert {i: (r["text"], r["n_lines"], r["n_removed_lines"]) for i, r in rows.items()} == {0: ("x\ny", 2, 0), 1: ("z", 2, 1), 2: ("", 1, 1), 3: (None, 0, 0)}
    assert all(r[c] == i + 100 for i, r in rows.items() for c in ("_rk", "_rk2", "_drop", "_row", "h1", "pos", "site", "first", "_slot"))
    said = language_id.predict_languages(docs, language_id.fit_languages(docs))
    assert sorted(said.columns) == sorted(docs.columns) and dict(said.dtypes)["lang_pred"] == "string" and said.count() == 4


@pytest.mark.parametrize("partitions", [1, 3])
def test_a_hot_line_is_dealt_over_slots(make, spark, partitions):
    texts = ["hot line\nown %d" % i for i in range(300)] + ["warm\nhot line"] * 20
    docs = make(texts, source=[f"s{i % 40}" for i in range(320)]).repartition(partitions)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], r["text"]) for r in line_dedup.remove_boilerplate(docs).collect()}
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by name
    assert got == {r[0]: (r[1], r[2], r[3]) for r in duckdb.sql(OP6_SQL).fetchall()}


def test_language_sample_is_bounded(make):
    """Repeated and null ids, and one text very many times, do not swell the sample; every language is learned."""
    words = {f"l{k:03d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("ka", "lo", "mi", "nu")] for k in range(230)}
    texts = [f"{' '.join(w * 3)}" for w in words.values() for _ in range(2)] + ["ein satz"] * 300
    lang = [k for k in words for _ in range(2)] + ["de"] * 300
    docs = make(texts, ids=[None if i % 2 else 5 for i in range(len(texts))], lang=lang)
    model = language_id.fit_languages(docs, language_id.LanguageParams(dims=1 << 10, max_landmarks=300))
    assert model.languages == sorted({*words, "de"}) and model.landmarks.shape[1] <= 300


def test_kernel_ridge_equals_a_plain_twin():
    """Kernel, Nystroem features and ridge solution once more, by sets of n-grams and dense targets."""
    rng = random.Random(4)
    p = language_id.LanguageParams(landmarks=5, dims=1 << 12)
    texts = [" ".join(rng.choices(["the", "of", "house", "and"] if i % 3 else ["der", "und", "haus", "die"], k=8)) for i in range(60)]
    labels = ["en" if i % 3 else "de" for i in range(60)]

    def grams(t):
        t = " " + t + " "
        return {t[i : i + n] for n in range(1, p.max_n + 1) for i in range(len(t) - n + 1)}

    rows = np.zeros((60, p.dims), np.uint8)
    for t, r in zip(texts, rows, strict=True):
        language_id.presence(t, p, r)
    order = sorted(range(60), key=lambda i: labels[i])
    model = language_id.fit_kernel_ridge(rows[order], [labels[i] for i in order], p)
    got = model.scores(rows.astype(np.float32))
    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [i for k in ("de", "en") for i in [j for j in order if labels[j] == k][:5]]
    kmm = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(kmm)
    good = value > 1e-8 * value.max()
    white = vector[:, good] / np.sqrt(value[good])
    phi = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in range(60)]) @ white
    y = np.array([[1.0 if labels[i] == k else -1.0 for k in ("de", "en")] for i in range(60)])
    weight = np.array([60 / (2 * labels.count(k)) for k in labels])[:, None]
    w = np.linalg.solve(phi.T @ (weight * phi) + p.ridge * 60 * np.eye(phi.shape[1]), phi.T @ (weight * y))
    want = phi @ w
    assert (got.argmax(1) == want.argmax(1)).all() and np.abs(got - want).max() < 0.1


def test_fences_equal_a_plain_twin(make):
    """Quantiles of groups small enough for exact sketches, fences and filtering once more over lists."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "bb", "#c", "dddd", "e&", "ff"], k=rng.randrange(40, 90))) + "\nx" * rng.randrange(3) for _ in range(240)]
    lang, source = [("en", "fr")[i % 2] for i in range(240)], [f"s{i % 5 // 2}" for i in range(240)]
    p = quality_rules.QualityParams(spread=1.0)
    got = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(make(texts, lang=lang, source=source), p).collect()}
    metrics = list(quality_rules.METRICS)
    good = [i for i in got if not got[i]["base_failed"]]
    group = lambda i, key: [j for j in good if key(j) == key(i)]

    def quantile(xs, q):
        xs = sorted(xs)
        return xs[min(len(xs) - 1, max(0, int(np.ceil(q * len(xs) - 1e-9)) - 1))]

    for i in good:
        wide = group(i, lambda j: lang[j])
        wide = wide if len(wide) >= p.min_group else good
        own = group(i, lambda j: (lang[j], source[j]))
        own = own if len(own) >= p.min_group else wide
        kept = True
        for m in metrics:
            up, down, outer, share = quality_rules.METRICS[m]
            q, w = ([quantile([got[j][m] for j in g], x) for x in (1 - outer, 0.5, outer)] for g in (own, wide))
            top = q[2] + p.spread * share * max(q[2] - q[1], w[2] - w[1]) if up else float("inf")
            bottom = q[0] - p.spread * share * max(q[1] - q[0], w[1] - w[0]) if down else -float("inf")
            kept = kept and bottom <= got[i][m] <= top
        assert got[i]["kept"] == kept
    assert 0 < sum(got[i]["kept"] for i in good) < len(good)


def test_kernel_ridge_spreads_out_few_rows_at_once():
    """The driver never holds all presence rows as numbers; bits in bytes and blocks of any size give the same model."""
    rng = np.random.default_rng(5)
    p = language_id.LanguageParams(dims=(1 << 13) - 3)
    rows = (rng.random((1200, p.dims)) < rng.choice([0.02, 0.1], (3, p.dims))[np.arange(1200) % 3]).astype(np.uint8)
    labels = [("de", "en", "fr")[i % 3] for i in range(1200)]
    tracemalloc.start()
    try:
        model = language_id.fit_kernel_ridge(rows, labels, p)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < rows.size * 4  # less than one copy in numbers of 32 bits
    scores = model.scores(rows[:100].astype(np.float32))
    for other in (
        language_id.fit_kernel_ridge(np.packbits(rows, axis=1), labels, p, packed=True),
        language_id.fit_kernel_ridge(rows, labels, language_id.LanguageParams(dims=p.dims, batch=7)),
    ):
        assert (other.landmarks == model.landmarks).all()
        assert np.allclose(other.scores(rows[:100].astype(np.float32)), scores, atol=1e-4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_languages(docs.where(~language_id.held_out()))
    out = language_id.predict_languages(docs.withColumn("held_out", language_id.held_out()), model)
    rows = [(r["lang"], r["lang_pred"], r["score"]) for r in out.where("held_out").collect()]
    assert sum(a == b for a, b, _ in rows) / len(rows) >= 0.95
    assert all(0 <= s <= 1 for _, _, s in rows)


def test_language_edges(make, spark):
    docs = make([None, "", "123 --- !!", "the and of the and", "der die und das", "der die und"], lang=["en", "en", "en", "en", "de", None])
    model = language_id.fit_languages(docs)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict_languages(docs, model, keep_text=False).collect()}
    assert [got[i][0] for i in range(6)] == ["und", "und", "und", "en", "de", "de"] and got[0][1] == 0
    nothing = language_id.fit_languages(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.predict_languages(docs, nothing).collect()} == {"und"}
    assert language_id.predict_languages(docs.where("false"), model).count() == 0


def test_kernel_is_presence_only():
    p = language_id.LanguageParams()
    a, b = np.zeros(p.dims, np.uint8), np.zeros(p.dims, np.uint8)
    assert language_id.presence("Ab ab", p, a) and language_id.presence("ab, AB 7 ab", p, b)
    assert (a == b).all()


def test_cotraining_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = cotraining.fit_quality(docs, labels.where("doc_id % 3 <> 0"))
    rows = cotraining.score_quality(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows) >= 0.9
    assert cotraining.score_quality(docs, model).count() == docs.count()


def test_cotraining_edges(make, spark):
    docs = make([None, "", "good words here", "bad"], ids=[0, 1, 1, None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotraining.fit_quality(docs, none) is None
    rows = cotraining.score_quality(docs, None).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 and r["kept"] for r in rows)
    many = make([f"fine text number {i} with words" if i % 2 else "### $$$ %%% junk &&&" for i in range(60)] + [None])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = cotraining.fit_quality(many, labels)
    got = {r["doc_id"]: r["kept"] for r in cotraining.score_quality(many, model).collect()}
    assert all(got[i] == bool(i % 2) for i in range(50, 60)) and 60 in got
    assert cotraining.score_quality(many.where("false"), model).count() == 0


def test_cotraining_equals_a_plain_twin(make, spark):
    """Views, rounds and choice of documents once more, over lists in one place."""
    rng = random.Random(3)
    good, bad = [f"fine{i}" for i in range(40)], [f"poor{i}" for i in range(40)]
    texts = [" ".join(rng.choices(good if i % 2 else bad, k=30)) for i in range(400)] + [None, "", " "]
    texts[7], texts[9] = texts[5], texts[5]
    ids = [None if i in (20, 21) else i for i in range(len(texts))]
    lang = [("en", "fr")[i % 2] if rng.random() < 0.9 else None for i in range(len(texts))]
    source = [("x" * 70 + "ab"[i % 2]) for i in range(len(texts))]
    docs = make(texts, ids=ids, lang=lang, source=source)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 5) if ids[i] is not None] + [(5, 0), (None, 1)], "doc_id long, quality int")
    p = cotraining.CoTrainParams(words=256, meta=64, rounds=3, handed=10, sure=0.8)
    views = cotraining.quality_views(docs, p)
    model = cotraining.fit_quality(views, labels, p)

    rows = views.collect()
    for r in rows:
        if r["doc_id"] is None:
            continue
        words = set((texts[r["doc_id"]] or "").split())
        assert np.unpackbits(np.frombuffer(r["bits"], np.uint8)).sum() <= len(words)
    y = {r["doc_id"]: r["quality"] for r in labels.orderBy("quality").collect() if r["doc_id"] is not None}
    dense = lambda rs: (cotraining.dense_text([r["bits"] for r in rs], [r["ratios"] for r in rs], p), cotraining.dense_meta([r["places"] for r in rs], p))
    have = sorted((r for r in rows if r["doc_id"] in y), key=lambda r: int(cotraining.mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0]))
    pool = sorted({(r["h1"], r["h2"]): r for r in rows if r["doc_id"] not in y}.values(), key=lambda r: (r["h1"], r["h2"]))
    xs, ys = dense(have), np.array([y[r["doc_id"]] for r in have])
    every, back = dense(pool), np.arange(len(ys)) % 4 == 3
    train = [[(x, l) for x, l, b in zip(xs[v], ys, back, strict=True) if not b] for v in (0, 1)]
    weights = [cotraining.fit_logistic(np.array([x for x, _ in t]), np.array([float(l) for _, l in t]), p.ridge) for t in train]
    used: list[dict] = [{}, {}]
    for _ in range(p.rounds):
        hand: list[list] = [[], []]
        for v in (0, 1):
            w = weights[v].astype(np.float32)
            a, b = cotraining.fit_platt(xs[v][back] @ weights[v][:-1] + weights[v][-1], ys[back])
            prob = np.round(1 / (1 + np.exp(-(a * (every[v] @ w[:-1] + w[-1]) + b).astype(float))), 6)
            for label in (0, 1):
                sure = prob if label else 1 - prob
                best = sorted((-sure[i], i) for i in range(len(pool)) if sure[i] >= p.sure and i not in used[1 - v])[: p.handed]
                hand[1 - v] += [(i, label) for _, i in best]
        if not any(hand):
            break
        for v in (0, 1):
            used[v] |= dict(hand[v])
            train[v] += [(every[v][i], label) for i, label in hand[v]]
            weights[v] = cotraining.fit_logistic(np.array([x for x, _ in train[v]]), np.array([float(l) for _, l in train[v]]), p.ridge, weights[v], 60)
    assert sum(map(len, used)) > 20
    assert np.allclose(model.text, weights[0], atol=1e-3) and np.allclose(model.meta, weights[1], atol=1e-3)
