import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from fieldspark.llm import suffix_dedup as R
from fieldspark.llm.common import row_key


def corpus(seed, n=60, alphabet="abcdefgh ü\n"):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choices(alphabet, k=k))
    shared = [say(rng.randrange(10, 60)) for _ in range(6)]
    texts = ["", "ab", "a" * 90, "abc" * 40, None]
    for _ in range(n):
        t = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(shared) + t[at:]
        texts.append(t)
    return texts + texts[6:9]


@pytest.mark.parametrize("length,gram,hot,chunk", [(20, 8, 4000, 10**6), (20, 20, 4000, 10**6), (12, 4, 0, 10**6), (24, 6, 3, 10**6), (16, 5, 5, 60)])
def test_every_way_equals_brute_force(make, length, gram, hot, chunk):
    texts = corpus(length + gram)
    p = R.RepeatParams(length=length, gram=gram, hot=hot, chunk=chunk)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.repeat_digest(make(texts), p).collect()}
    assert got == brute.repeat_digest(list(enumerate(texts)), length)


@pytest.mark.parametrize("hot", [4000, 0])
def test_first_copy_stays(make, hot):
    texts = corpus(77, 40, "abcdefgh \n")
    p = R.RepeatParams(length=16, gram=6, hot=hot, keep="first")
    got = {r["doc_id"]: r["text"] for r in R.remove_repeats(make(texts), p).collect()}
    plain = [(t or "").encode() for t in texts]
    for i, (b, mask) in enumerate(zip(plain, brute.repeat_masks(plain, 16, "first"), strict=True)):
        assert got[i] == (None if texts[i] is None else bytes(x for x, gone in zip(b, mask, strict=True) if not gone).decode())


@pytest.mark.parametrize("hot", [4000, 2, 0])
def test_first_copy_stays_of_repeated_rows_and_ids(make, hot):
    """Rows that repeat an id and a text, ids of several texts and null ids: one whole copy of every passage is left."""
    texts = corpus(78, 40, "abcdefgh \n")
    rng = random.Random(9)
    rows = [(None if rng.random() < 0.2 else rng.randrange(25), t) for t in texts]
    rows += rng.choices(rows, k=25) + [(1, texts[8])] * 3 + [(2, "xy" + (texts[8] or "") + "z")]
    p = R.RepeatParams(length=16, gram=6, hot=hot, keep="first")
    df = make([t for _, t in rows], ids=[i for i, _ in rows])
    keyed = {(r["doc_id"], r["text"]): r["_rk"] for r in df.select("doc_id", "text", *row_key()).collect()}
    order = sorted(set(rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], keyed[r]))
    masks = brute.repeat_masks([(t or "").encode() for _, t in order], 16, "first")
    want = {(i, t): None if t is None else bytes(x for x, gone in zip(t.encode(), m, strict=True) if not gone).decode() for (i, t), m in zip(order, masks, strict=True)}
    got = sorted(((r["doc_id"], r["text"]) for r in R.remove_repeats(df, p).collect()), key=str)
    assert got == sorted(((i, want[i, t]) for i, t in rows), key=str)


def test_passage_of_repeated_rows_is_not_lost(make):
    rng = random.Random(11)
    t = "".join(rng.choices("abcdefghij \n", k=1399))
    df = make([t, t, "start " + t[300:900] + " end"], ids=[1, 1, 2])
    got = [r["text"] for r in R.remove_repeats(df).orderBy("doc_id").collect()]
    assert got[:2] == [t, t] and len(got[2]) < 30


def test_characters_stay_whole(make):
    base = "".join(chr(0xC0 + i) for i in range(150))
    df = make(["x" + base + "y", "z" + base + "w", "plain"])
    out = R.remove_repeats(df, R.RepeatParams(length=20, gram=8, keep="first"))
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == "x" + base + "y" and got[2] == "plain" and got[1][0] == "z" and got[1][-1] == "w" and len(got[1]) < 10


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    for _ in range(150):
        base = bytes(rng.integers(97, 99, 30).astype(np.uint8))
        contexts = [bytes(rng.integers(97, 99, rng.integers(12, 30)).astype(np.uint8)) + base[: rng.integers(5, 30)] for _ in range(6)]
        begin, later, any_copy = R.repeated_windows(contexts, 12)
        seen = {}
        for i, c in enumerate(contexts):
            for s in range(len(c) - 11):
                seen.setdefault(c[s : s + 12], []).append(begin[i] + s)
        first, every = np.zeros(len(later), bool), np.zeros(len(later), bool)
        for places in seen.values():
            if len(places) > 1:
                every[places] = True
                first[places[1:]] = True
        assert (first == later).all() and (every == any_copy).all()


def test_nulls_repeats_and_empty(make):
    t = "q" * 7 + "the same passage of words that comes back" * 2
    df = make([None, "", t, t, t], ids=[None, 1, 2, 2, None])
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in R.repeat_digest(df, R.RepeatParams(length=30, gram=10)).collect())
    n = len(t)
    assert got == [("1", 0, 0), ("2", n, n), ("2", n, n), ("None", 0, 0), ("None", n, n)]
    assert R.repeat_digest(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        R.RepeatParams(keep="all")


def test_whole_small_table(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.repeat_digest(docs).collect()}
    assert got == brute.repeat_digest(rows, 200)


def test_stretches_of_contexts_that_look_alike():
    """What is packed comes back, and a pair whose sides differ is told by the suffix order."""
    rng = random.Random(12)
    p = R.RepeatParams(length=20, gram=8)
    text = np.frombuffer("".join(rng.choices("abcdefgh", k=300)).encode(), np.uint8)
    other = np.concatenate([np.frombuffer(b"xyz", np.uint8), text])
    broken = other.copy()
    broken[3 + 40] += 1
    h, c, lo, size = R.anchors(text, p)
    some = np.r_[0:4, 9:14]
    h, lo, size = h[some].view(np.int64), lo[some], size[some]
    for tail, wrong in ((other, 0), (broken, 1)):
        blob = R.stretch_entry(5, R.LEAD, text, h, lo, size) + R.stretch_entry(5, R.TAIL, tail, h, lo + 3, size)
        (_, _, none, a), (pair, side, items, b) = R.stretch_entries(blob)
        assert (pair, side, none.shape) == (5, R.TAIL, (4, 0)) and [len(x) for x in a] == [len(x) for x in b]
        for i in range(len(some)):
            assert a[items[1, i]][items[2, i] : items[2, i] + size[i]] == text[lo[i] : lo[i] + size[i]].tobytes()
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([3], pa.int32()), pa.array([2], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "kind", "n", "blob"])
        said = {x for out in R._factor_pass(p)(iter([batch])) for x in out.column(0).to_pylist()}
        hurt = {int(x) for x, at, n in zip(h, lo, size, strict=True) if at <= 40 < at + n}
        assert (said == hurt) if wrong else not said
