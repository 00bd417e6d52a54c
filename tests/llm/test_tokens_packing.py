import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from fieldspark.llm import packing, tokens

ODD = ["", "   \n\n x", "don't WE'LL", "naïve café 東京 🎉🎉 ١٢٣", "▁▁   ", "a" * 5000, "<|endoftext|>", "tab\t\tend  ", "\r\n\r\n"]


def random_texts(seed, n=300):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x3000, 0x9000), rng.randrange(0x1F300, 0x1F600), 9, 10, 32]))
    return ODD + ["".join(pick() for _ in range(rng.randrange(60))) for _ in range(n)]


def test_encoder_is_the_rank_tables_own():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = tokens.ByteBpe(path, remember=50)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert packing.GPT_PATTERN == P.PATTERN
    vocab = [t.decode("utf8", "ignore") for t in bpe.by_rank[::37]]
    for t in random_texts(1) + vocab:
        ids = bpe.encode(t)
        assert ids == own.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_round_trip_query_shape(make):
    texts = [*ODD, None]
    docs = make(texts)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = tokens.byte_bpe(path)
    for r in tokens.round_trip_digest(docs, path).collect():
        t = texts[r["doc_id"]] or ""
        ids = np.array(bpe.encode(t), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    enc = tokens.encode_documents(docs, path)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in tokens.decode_documents(enc, path).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert tokens.round_trip_digest(docs.where("false"), path).count() == 0


def test_json_vocabulary_as_ranks():
    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    enc = packing.byte_level_encoding(path)
    end = "<|endoftext|>"
    special = [end, end * 3, f"{end}a", f"a{end}", f"a {end}  {end}\n\n b", f" {end} ", "<|endoftext|", f"<|{end}|>", f"x\n {end}\n 1"]
    for t in random_texts(2) + special:
        assert enc.encode(t, allowed_special="all") == whole.encode(t, add_special_tokens=False).ids


def test_added_tokens_in_the_operator(make):
    path, texts = P.path("byte_bpe_50k.json"), ["a<|endoftext|>b", "<|endoftext|>", "", None, "y" * 300_000]
    whole = Tokenizer.from_file(path)
    for r in packing.pack_documents(make(texts), path, length=1 << 20).collect():
        ids = np.array(whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0], "<u4")
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())


def check_packing(rows, length):
    """Every piece of a document in order, every sequence gapless from 0 and within bounds."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return by_doc, by_seq


@pytest.mark.parametrize("open_bins,block", [(16384, 8192), (4, 3)])
def test_packing(make, open_bins, block):
    rng = random.Random(4)
    texts = [*ODD, None, *[" ".join(rng.choices(["alpha", "beta", "gamma,", "x1"], k=rng.randrange(200))) for _ in range(150)]]
    length = 64
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack_documents(make(texts), path, length, open_bins=open_bins, block=block).collect()
    by_doc, by_seq = check_packing(rows, length)
    enc = packing.byte_level_encoding(path)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*enc.encode(t or "", allowed_special="all"), 0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == length for r in pieces[1:]) and (len(pieces) == 1) == (len(ids) <= length)
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    least = -(-total // length)
    assert len(by_seq) <= least * (1.03 if open_bins > 100 else 1.35) + 2
    assert packing.pack_documents(make([]), path, length).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert fit.put(6) == (0, 0) and fit.put(7) == (1, 0)
    assert fit.put(3) == (1, 7)  # bin 1 is tighter than bin 0
    assert fit.put(9) == (2, 0) and fit.n_open == 2
    assert fit.put(8) == (3, 0) and fit.n_open == 2  # bin 2, with one place left, is closed
    assert fit.put(1) == (3, 8) and fit.put(4) == (0, 6)
