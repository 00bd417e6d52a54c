"""N-gram Jaccard join by PartEnum signatures.

Two sets A, B with J(A, B) >= t have a Hamming distance of at most
k = (|A| + |B|)(1 - t)/(1 + t).  Set sizes are covered by overlapping windows so
that the sizes of any such pair share a window.  Inside a window of largest size R
the feature domain (the shingle hashes) is cut at two levels.  Of the n1 first-level
partitions at most k(R) // (k2 + 1) can hold more than k2 of the differences; with
n1 = k(R) // (k2 + 1) + 1 + e the pair has e + 1 others at least.  Each of those is cut
into n2 second-level partitions, of which k2 at most differ, so the pair agrees on some
subset of n2 - k2 of them.  All these subsets are enumerated: a signature is one
(window, first-level partition, subset of its second-level ones, projection).  k2 and
n2 are chosen for each window (``scheme``).  Each set leaves out the e // 2 first-level
partitions in which it has the fewest features, which still leaves one that both sets
of a pair have.

One Python pass over the texts packs signatures into buckets (a few large rows a
task).  Sets that share a signature are compared by parity sketches, whose distance
is never above the true one, and a forest of the pairs that may link - never all
pairs - becomes candidate edges.  A signature that very many sets of one batch carry
sends one of them on and ties the others to it, so it is one entry a batch.

Sketches grow with the set; the signature step uses them folded to a fixed size, and
a second look, once per set and size window of a component of candidates, uses them
whole, which keeps long texts with a few shared passages apart.

The components of what is left are the work units in which sets meet, each shipped
once.  A unit too large for one task is split by signature, and by pairs of
blocks beyond that, so nothing is dropped.  In a unit sketches rule pairs out, exact
intersection decides the others, and pairs that earlier links already connect are
skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import (
    ROW,
    U64,
    ascii_lower,
    buckets_of,
    documents_of,
    lean,
    may_be_in,
    mix,
    mix_int,
    pack_buckets,
    partitions,
    rolling,
    row_key,
    struct_of,
    unpack,
    word_spans,
    written,
)
from fieldspark.llm.components import components

SIG, EDGE, INFO, MULTI = 0, 1, 2, 3
PACKED = "bucket int, kind int, n int, blob binary"
SKETCH_WORDS = 8
MOST_SKETCH_WORDS = 512


@dataclass(frozen=True)
class JaccardParams:
    """Words per shingle, threshold num/den, spare first-level partitions, features a signature should have on average, sizes with windows of their
    own; bounds of one work unit (sets, shingles), of a signature's sets compared by sketch, and of its sets in one batch that go on one by one;
    rows and signatures of a batch, signatures of a bucket looked at together."""

    words: int = 4
    num: int = 85
    den: int = 100
    spare: int = 4
    features: int = 4
    small: int = 40
    unit_sets: int = 16384
    unit_shingles: int = 4_000_000
    bucket_sets: int = 16384
    batch_hot: int = 64
    batch_rows: int = 4096
    batch_sigs: int = 1 << 18
    bucket_sigs: int = 1 << 19

    def most_different(self, total: int) -> int:
        """Largest Hamming distance of two linked sets whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def windows(self, n: int) -> tuple[Scheme, ...]:
        """The schemes of every size window that holds sets of size ``n``."""
        return _windows(self, n)


@dataclass(frozen=True)
class Scheme:
    """One size window: its number, first-level partitions and how many each set leaves out, second-level ones and how many may differ."""

    window: int
    first: int
    left_out: int
    second: int
    differ: int

    def subsets(self) -> list[tuple[int, ...]]:
        """The enumerated subsets of second-level partitions."""
        return list(combinations(range(self.second), self.second - self.differ))


@lru_cache(maxsize=1 << 12)
def scheme(p: JaccardParams, window: int, low: int, high: int) -> Scheme:
    """The cheapest choice (fewest signatures) that gives sets of ``low`` shingles ``features`` a signature, unless that takes half as many
    signatures again as the cheapest of all.  Sets of a window that cannot differ in anything are one partition, the whole set.
    """
    k = p.most_different(2 * high)
    if k == 0:
        return Scheme(window, 1, 0, 1, 0)
    made = []
    for differ, second in ((1, 3), (1, 4), (2, 4), (2, 5), (3, 6)):
        bad = k // (differ + 1)
        # spares only where there is more than one partition to choose from
        spare = min(p.spare, 2 * (bad // 2)) + 2 * (bad // 20)
        first = bad + 1 + spare
        ways = comb(second, differ)
        made.append((low * (second - differ) / (first * second), (first - spare // 2) * ways, Scheme(window, first, spare // 2, second, differ)))
    least = min(m[1] for m in made)
    good = [m for m in made if m[0] >= p.features and 2 * m[1] <= 3 * least] or made
    return min(good, key=lambda m: m[1])[2]


@lru_cache(maxsize=1 << 16)
def _windows(p: JaccardParams, n: int) -> tuple[Scheme, ...]:
    out, lo, j = [], 1, 0
    while lo <= n:
        # small sizes have windows of their own, where few features must not meet many partitions
        nxt = max(lo + 1, int(lo * p.den / p.num)) if lo > p.small else lo + 1
        hi = (nxt - 1) * p.den // p.num
        if n <= hi:
            out.append(scheme(p, j, lo, hi))
        lo, j = nxt, j + 1
    return tuple(out)


def shingle_set(text: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (lower-cased A-Z; a shorter text is one shingle)."""
    start, end = word_spans(text)
    if len(start) == 0:
        return np.zeros(0, U64)
    roll = rolling(0x1D872B41)
    word = roll.spans(roll.prefix(ascii_lower(text)), start, end)
    m = min(words, len(word))
    h = word[: len(word) - m + 1].copy()
    for i in range(1, m):
        h = mix(h * U64(0x9E3779B97F4A7C15) + word[i : len(word) - m + 1 + i])
    return np.unique(mix(h + U64(m)))


def set_node(s: np.ndarray) -> int:
    """A set's identity: equal sets, however many documents hold them, are one vertex."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(s ^ U64(0xA5A5A5A5))) + U64(len(s)) * U64(0x9E3779B97F4A7C15)], U64))[0])


def signatures(s: np.ndarray, p: JaccardParams) -> np.ndarray:
    """PartEnum signatures of a sorted set of hashes: every enumerated subset of every first-level partition that is not left out."""
    out = []
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(s))])
    high = s >> U64(32)
    for w in p.windows(len(s)):
        cells = w.first * w.second
        # cells of the domain by the hash's upper half: a first-level partition is ``second`` neighbouring cells
        edge = np.searchsorted((high * U64(cells)) >> U64(32), np.arange(cells + 1, dtype=U64))
        code = mix(np.arange(cells, dtype=U64) + U64((w.window << 40) + (cells << 20)))
        cell = mix((total[edge[1:]] - total[edge[:-1]]) ^ code).reshape(w.first, w.second)
        if w.left_out:
            held = np.diff(edge[:: w.second])
            cell = cell[np.argsort(held, kind="stable")[w.left_out :]]
        # cells carry their place, so a sum over a subset is a projection of its own
        out += [mix(cell[:, list(subset)].sum(1, dtype=U64)) for subset in w.subsets()]
    return np.concatenate(out) if out else np.zeros(0, U64)


def sketch_words(n: int | np.ndarray):
    """Words of the sketch of a set of ``n``: a power of two, at least as many bits as features (up to a bound)."""
    power = np.ceil(np.log2(np.maximum(n, 1) / 64)).astype(int)
    return np.clip(2 ** np.maximum(power, 0), SKETCH_WORDS, MOST_SKETCH_WORDS)


def sketch(s: np.ndarray, words: int | None = None) -> np.ndarray:
    """Parities of the features hashed to each bit: two sketches differ in no more bits than the sets in features."""
    words = words or int(sketch_words(len(s)))
    bit = (mix(s + U64(0x5E7)) >> U64(40)).astype(np.int64) & (words * 64 - 1)
    odd = (np.bincount(bit, minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(U64)


def fold(sk: np.ndarray, words: int) -> np.ndarray:
    """A sketch as it would be with fewer words."""
    return np.bitwise_xor.reduce(sk.reshape(-1, words), axis=0)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of a sorted array."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(key)])


def _sorted_distinct(key: np.ndarray, node: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) rows in order; a key is hot if any of its rows is."""
    order = np.lexsort((node, key))
    key, node, hot = key[order], node[order], hot[order]
    if len(key):
        at, size = _runs(key)
        hot = np.repeat(np.maximum.reduceat(hot, at), size)
        keep = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, hot = key[keep], node[keep], hot[keep]
    return key, node, hot


def _star(at: np.ndarray, size: np.ndarray, node: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the first node of each chosen run to the run's others."""
    hub = np.repeat(node[at], size)
    edge = np.repeat(chosen, size)
    edge[at] = False
    return hub[edge], node[edge]


def pack_signatures(bucket: np.ndarray, key: np.ndarray, owner: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Per bucket: the number of owners, the owners, how many rows each has, and, owner by owner, the upper half of each row's key and
    whether it is hot.

    Inside a bucket half a key tells all but some 0.01% of signatures apart; those that it does not are compared by sketches like others.
    """
    order = np.lexsort((owner, bucket))
    bucket, owner, hot, half = bucket[order], owner[order], hot[order], (key[order] >> U64(32)).astype(np.uint32)
    at, count = _runs(bucket)
    turn = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]) if len(bucket) else at
    cut = np.searchsorted(turn, np.r_[at, len(bucket)])
    for lo, n, i, j in zip(at, count, cut[:-1], cut[1:], strict=True):
        times = np.diff(np.r_[turn[i:j], lo + n]).astype(_times_kind(n))
        yield int(bucket[lo]), int(n), np.int64(j - i).tobytes() + owner[turn[i:j]].tobytes() + times.tobytes() + half[lo : lo + n].tobytes() + hot[lo : lo + n].tobytes()


def _times_kind(n: int) -> np.dtype:
    return np.dtype(np.uint32 if n > 0xFFFF else np.uint16)


def unpack_signatures(n: int, blob: bytes) -> list[np.ndarray]:
    m = int(np.frombuffer(blob, np.int64, 1)[0])
    kind = _times_kind(n)
    owners, times = np.frombuffer(blob, U64, m, 8), np.frombuffer(blob, kind, m, 8 + 8 * m)
    key, hot = unpack(n, blob[8 + (8 + kind.itemsize) * m :], np.uint32, np.uint8)
    return [key, np.repeat(owners, times), hot]


def _signature_pass(p: JaccardParams, n_buckets: int):
    bucket = lambda x: (x % U64(n_buckets)).astype(np.int64)

    most = max(p.batch_sigs, 16 * n_buckets)

    def packed(rk: list[np.ndarray], nodes: list[int], sizes: list[int], sketches: list[np.ndarray], sigs: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        keys, node, size = np.concatenate(rk, axis=1), np.array(nodes, U64), np.array(sizes, np.int64)
        rows = []
        order = np.argsort(bucket(node), kind="stable")
        for x, c in zip(*_runs(bucket(node)[order]), strict=True):
            i = order[x : x + c]
            rows.append((int(bucket(node[i[:1]])[0]), INFO, int(c), b"".join([keys[0, i].tobytes(), keys[1, i].tobytes(), node[i].tobytes(), size[i].tobytes(), *(sketches[t].tobytes() for t in i)])))
        if sigs:
            key, owner = np.concatenate(sigs), np.concatenate(owners)
            sigs.clear()
            owners.clear()
            key, owner, hot = _sorted_distinct(key, owner, np.zeros(len(key), np.uint8))
            at, count = _runs(key)
            often = count > p.batch_hot
            if often.any():
                a, b = _star(at, count, owner, often)
                rows += [(x, EDGE, n, blob) for x, n, blob in pack_buckets(bucket(a), a, b)]
                hot = np.repeat(often, count).astype(np.uint8)
                keep = hot == 0
                keep[at] = True
                key, owner, hot = key[keep], owner[keep], hot[keep]
            rows += [(x, SIG, n, blob) for x, n, blob in pack_signatures(bucket(key), key, owner, hot)]
        return _packed_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [], [])
        seen, n = set(), 0
        for batch in batches:
            rk = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(U64) for c in ROW])
            for i, text in enumerate(documents_of(batch)):
                s = shingle_set(text, p.words)
                node = set_node(s) if len(s) else 0
                for column, v in zip(held, (rk[:, i : i + 1], node, len(s), sketch(s)), strict=False):
                    column.append(v)
                if len(s) and node not in seen:
                    seen.add(node)
                    g = signatures(s, p)
                    held[4].append(g)
                    held[5].append(np.full(len(g), node, U64))
                    n += len(g)
                # as many signatures as fill a few megabytes, however long the texts are
                if n > most or len(held[0]) == p.batch_rows:
                    yield packed(*held)
                    held, n = ([], [], [], [], [], []), 0
                    seen.clear()
        if held[0]:
            yield packed(*held)

    return run


def _packed_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    b, k, n, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "n", "blob"])


FOUND = "kind int, a long, a2 long, b long, n long, sketch binary, whole binary"


def _found(kind: int, a: np.ndarray, b: np.ndarray, a2: np.ndarray | None = None, n: np.ndarray | None = None, sk: list[np.ndarray] | None = None) -> pa.RecordBatch:
    size = pa.array(np.zeros(len(a), np.int64) if n is None else n)
    second = pa.nulls(len(a), pa.int64()) if a2 is None else pa.array(np.ascontiguousarray(a2).view(np.int64))
    none = pa.nulls(len(a), pa.binary())
    short = none if sk is None else pa.array([fold(x, SKETCH_WORDS).tobytes() for x in sk], pa.binary())
    whole = none if sk is None else pa.array([x.tobytes() if len(x) > SKETCH_WORDS else None for x in sk], pa.binary())
    ends = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), ends[0], second, ends[1], size, short, whole], ["kind", "a", "a2", "b", "n", "sketch", "whole"])


def _group_of(node: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A number for each run of distinct sets that depends on nothing but which sets they are."""
    return mix(np.add.reduceat(mix(node), at) ^ mix(count.astype(U64)))


def _first_of_each(x: np.ndarray) -> np.ndarray:
    first = np.zeros(len(x), bool)
    first[np.unique(x, return_index=True)[1]] = True
    return first


def _bucket_pass(p: JaccardParams):
    """Of each bucket: the documents' sets (INFO: row key, set, size, sketch), groups of sets that share a signature (MULTI:
    group, set), and plain trees of candidate edges for signatures that too many sets share.  Near copies share many
    signatures: a group is the same, whatever signature it shares, and comes once of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in buckets_of(batches):
            parts, ea, eb = [], [], []
            for kind, n, blob in held:
                if kind == INFO:
                    rk, rk2, nd, size = unpack(n, blob, U64, U64, U64, np.int64)
                    ends = 32 * n + np.cumsum(8 * sketch_words(size))
                    yield _found(INFO, rk, nd, rk2, size, [np.frombuffer(blob, U64, w, e - 8 * w) for w, e in zip(sketch_words(size), ends, strict=True)])
                elif kind == SIG:
                    parts.append((n, blob))
                else:
                    a, b = unpack(n, blob, U64, U64)
                    ea.append(a)
                    eb.append(b)
            # a bucket's signatures are looked at by ranges of their values, so that few are unpacked at once
            ranges = 1 + sum(n for n, _ in parts) // p.bucket_sigs
            for part in range(ranges if parts else 0):
                some = []
                for n, blob in parts:
                    key, node, hot = unpack_signatures(n, blob)
                    mine = (key.astype(U64) * U64(ranges)) >> U64(32) == U64(part)
                    some.append((key[mine], node[mine], hot[mine]))
                key, node, hot = _sorted_distinct(*(np.concatenate(x) for x in zip(*some, strict=True)))
                at, count = _runs(key)
                plain = (count > 1) & ((hot[at] > 0) | (count > p.bucket_sets))
                a, b = _star(at, count, node, plain)
                ea.append(a)
                eb.append(b)
                multi = (count > 1) & ~plain
                if multi.any():
                    group = _group_of(node, at, count)
                    multi[multi] = _first_of_each(group[multi])
                    rows = np.repeat(multi, count)
                    yield _found(MULTI, np.repeat(group, count)[rows], node[rows])
            if ea:
                pair = np.unique(np.stack([np.concatenate(ea), np.concatenate(eb)], 1), axis=0)
                if len(pair):
                    yield _found(EDGE, pair[:, 0], pair[:, 1])

    return run


# --------------------------------------------------------------------------- which pairs may link, which do


def _forest(size: np.ndarray, sk: np.ndarray, p: JaccardParams, linked=None) -> np.ndarray:
    """The first member of each member's component, members in order of size.

    Pairs must have sizes and sketches that allow a link; ``linked(i, j)``, if given, then decides.  Pairs that are
    connected already are not looked at.
    """
    m = len(size)
    comp = np.arange(m)
    last = np.searchsorted(size, size * p.den // p.num, side="right")
    for i in range(m - 1):
        j = np.arange(i + 1, last[i])
        j = j[comp[j] != comp[i]]
        if len(j) == 0:
            continue
        far = np.bitwise_count(sk[j] ^ sk[i]).sum(1, dtype=np.int64)
        j = j[far * (p.den + p.num) <= (size[j] + size[i]) * (p.den - p.num)]
        if linked is None:
            if len(j):
                comp[np.isin(comp, comp[j])] = comp[i]
            continue
        for x in j:
            if comp[x] != comp[i] and linked(i, x):
                comp[comp == comp[x]] = comp[i]
    first = np.full(m, -1)
    first[comp[::-1]] = np.arange(m)[::-1]
    return first[comp]


def _plausible_pass(p: JaccardParams):
    """Rows (sig, node, n, sketch), sorted by signature, to candidate edges (a, b)."""

    def edges(sig: np.ndarray, node: np.ndarray, size: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((size, sig))
        sig, node, size, sk = sig[order], node[order], size[order], sk[order]
        at, count = _runs(sig)
        two = at[count == 2]
        far = np.bitwise_count(sk[two] ^ sk[two + 1]).sum(1, dtype=np.int64)
        ok = (far * (p.den + p.num) <= (size[two] + size[two + 1]) * (p.den - p.num)) & (size[two] * p.den >= size[two + 1] * p.num)
        a, b = [node[two[ok]]], [node[two[ok] + 1]]
        for x, c in zip(at[count > 2], count[count > 2], strict=True):
            hub = _forest(size[x : x + c], sk[x : x + c], p)
            moved = np.flatnonzero(hub != np.arange(c))
            a.append(node[x + hub[moved]])
            b.append(node[x + moved])
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pair[:, 0], pair[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            sk = np.frombuffer(b"".join(batch.column(3).to_pylist()), U64).reshape(-1, SKETCH_WORDS)
            cols = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), sk]
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last signature may go on
            rest = [c[cut:] for c in cols]
            if cut:
                a, b = edges(*(c[:cut] for c in cols))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])
        if rest is not None and len(rest[0]):
            a, b = edges(*rest)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

    return run


def _window_pass(p: JaccardParams):
    """Rows (unit, node, n, sketch) once for every size window the set is in (column ``x``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            js = [[w.window for w in p.windows(n)] for n in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(js)), [len(j) for j in js]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([j for w in js for j in w], pa.int64()), *[batch.column(i).take(row) for i in (1, 2, 3)]], ["unit", "x", "node", "n", "sketch"])

    return run


def _refine_pass(p: JaccardParams):
    """Units of whole sketches, sorted by (unit, x), to candidate edges; a unit with too many sets stays tied together, and is not held."""

    def tie(hub: int, held) -> tuple[np.ndarray, np.ndarray]:
        node = np.array([h[0] for h in held if h[0] != hub], np.int64)
        return np.full(len(node), hub, np.int64), node

    def finish(held, tied: int | None) -> pa.RecordBatch | None:
        if tied is not None:
            return _edges(*tie(tied, held)) if held else None
        if len(held) < 2:
            return None
        node, size = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        order = np.argsort(size, kind="stable")
        words = int(sketch_words(size).min())
        sk = np.stack([fold(np.frombuffer(held[i][2], U64), words) for i in order])
        hub = _forest(size[order], sk, p)
        moved = np.flatnonzero(hub != np.arange(len(order)))
        return _edges(node[order][hub[moved]], node[order][moved])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tied = None, [], None
        for batch in batches:
            for u, x, node, n, sk in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (u, x) != at:
                    if (out := finish(held, tied)) is not None:
                        yield out
                    at, held, tied = (u, x), [], None
                if tied is not None:
                    held.append((node, n, None))
                    if len(held) >= p.unit_sets:
                        yield _edges(*tie(tied, held))
                        held = []
                    continue
                held.append((node, n, sk))
                if len(held) > p.unit_sets:
                    tied = node
                    yield _edges(*tie(tied, held))
                    held = []
        if (out := finish(held, tied)) is not None:
            yield out

    return run


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])


def link_unit(nodes: np.ndarray, sets: list[np.ndarray], p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """Exact links inside one unit, as edges from each set to the first of its component."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    nodes, size, sets = nodes[order], size[order], [sets[i] for i in order]

    def linked(i: int, x: int) -> bool:
        at = np.searchsorted(sets[x], sets[i])
        at[at == size[x]] = size[x] - 1
        both = int(np.count_nonzero(sets[x][at] == sets[i]))
        return p.den * both >= p.num * (int(size[i]) + int(size[x]) - both)

    words = int(sketch_words(size.max()))
    hub = _forest(size, np.stack([sketch(s, words) for s in sets]), p, linked)
    moved = hub != np.arange(len(nodes))
    return nodes[hub[moved]], nodes[moved]


def _unit_pass(p: JaccardParams):
    def flush(held) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        one = {node: s for node, s in held}
        if len(one) < 2:
            return None
        a, b = link_unit(np.array(list(one), np.int64).view(U64), [np.frombuffer(s, U64) for s in one.values()], p)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for u, x, y, node, s in zip(*(batch.column(c).to_pylist() for c in ("unit", "x", "y", "node", "shingles")), strict=True):
                if (u, x, y) != at:
                    if (out := flush(held)) is not None:
                        yield out
                    at, held = (u, x, y), []
                held.append((node, s))
        if (out := flush(held)) is not None:
            yield out

    return run


def _set_pass(p: JaccardParams, with_signatures: bool):
    """Sets of the wanted documents, whose recomputed identity must match; with their signatures if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(batch.schema.get_field_index("node")).to_pylist()
            unit = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            rows = []
            for node, u, text in zip(want, unit, documents_of(batch), strict=True):
                s = shingle_set(text, p.words)
                if len(s) and int(np.array([set_node(s)], U64).view(np.int64)[0]) == node:
                    g = signatures(s, p).view(np.int64).tolist() if with_signatures else None
                    rows.append((u, node, s.tobytes(), g))
            u, node, s, g = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(node, pa.int64()), pa.array(s, pa.binary()), pa.array(g, pa.list_(pa.int64()))], ["unit", "node", "shingles", "sigs"])

    return run


_SETS = "unit long, node long, shingles binary, sigs array<long>"


def _linked(units: DataFrame, p: JaccardParams) -> DataFrame:
    n = partitions(units.sparkSession)
    dealt = units.repartition(n, "unit", "x", "y").sortWithinPartitions("unit", "x", "y")
    return dealt.mapInArrow(lean(_unit_pass(p)), "a long, b long")


def _large_units(sets: DataFrame, p: JaccardParams) -> DataFrame:
    """Units by signature for sets of oversized clusters, and by pairs of blocks for oversized signatures."""
    sig = sets.select("node", (F.length("shingles") / 8).cast("long").alias("n"), F.explode(F.array_distinct("sigs")).alias("unit"))
    per = sig.groupBy("unit").agg(F.count("*").alias("members"), F.sum("n").alias("weight")).where("members > 1")
    blocks = F.ceil(F.greatest(F.col("members") / (p.unit_sets / 2), F.col("weight") / (p.unit_shingles / 2))).cast("long")
    per = per.select("unit", F.when((F.col("members") <= p.unit_sets) & (F.col("weight") <= p.unit_shingles), 1).otherwise(blocks).alias("blocks"))
    own = sig.join(per, "unit").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = own.select("unit", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("unit", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return pairs.join(sets.select("node", "shingles"), "node").select("unit", "x", "y", "node", "shingles")


def _groups(docs: DataFrame, params: JaccardParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    p = params or JaccardParams()
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    n = partitions(spark)
    n_buckets = 4 * n
    packed = src.select(*ROW, "text").mapInArrow(lean(_signature_pass(p, n_buckets)), PACKED)
    found = written(packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_bucket_pass(p)), FOUND), "op1")
    info = found.where(F.col("kind") == INFO).select(F.col("a").alias("_rk"), F.col("a2").alias("_rk2"), F.col("b").alias("node"), "n")

    # groups of sets that share a signature, each once, with their sketches: which of them may link
    sketches = found.where((F.col("kind") == INFO) & (F.col("n") > 0)).select(F.col("b").alias("node"), "n", "sketch").dropDuplicates(["node"])
    multi = found.where(F.col("kind") == MULTI).select(F.col("a").alias("sig"), F.col("b").alias("node")).distinct()
    shared = multi.join(sketches, "node").select("sig", "node", "n", "sketch").repartition(n, "sig").sortWithinPartitions("sig")
    edges = shared.mapInArrow(lean(_plausible_pass(p)), "a long, b long").unionByName(found.where(F.col("kind") == EDGE).select("a", "b"))
    tied = components(edges)
    # each component of candidates once more with whole sketches, by windows of set sizes
    whole = found.where((F.col("kind") == INFO) & (F.col("n") > 0)).select(F.col("b").alias("node"), "n", F.coalesce("whole", "sketch").alias("sketch")).dropDuplicates(["node"])
    looked = tied.join(whole, "node").select(F.col("root").alias("unit"), "node", "n", "sketch")
    looked = looked.mapInArrow(lean(_window_pass(p)), "unit long, x long, node long, n long, sketch binary")
    candidates = components(looked.repartition(n, "unit", "x").sortWithinPartitions("unit", "x").mapInArrow(lean(_refine_pass(p)), "a long, b long"))
    # one document stands for each set
    stand = info.where("n > 0").groupBy("node").agg(F.min(F.struct(*ROW)).alias("r"), F.max("n").alias("n")).select("node", "r.*", "n")
    wanted = candidates.join(stand, "node")
    size = wanted.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("weight"))
    too_large = (F.col("sets") > p.unit_sets) | (F.col("weight") > p.unit_shingles)
    wanted = written(wanted.join(size, "root").select(*ROW, "node", F.col("root").alias("unit"), too_large.alias("large")), "op1")
    any_large = wanted.where("large").limit(1).count() > 0

    def sets_of(want: DataFrame, with_signatures: bool) -> DataFrame:
        # of most texts no set is wanted: they are not shuffled
        some = may_be_in(src.select(*ROW, "text"), want).where("_may").drop("_may")
        texts = some.join(want.hint("shuffle_hash"), list(ROW)).select("node", "unit", "text")
        return texts.mapInArrow(lean(_set_pass(p, with_signatures)), _SETS)

    small = sets_of(wanted.where("not large").drop("large"), False)
    links = _linked(small.select("unit", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "node", "shingles"), p)
    if any_large:
        large = written(sets_of(wanted.where("large").drop("large"), True), "op1")
        links = links.unionByName(_linked(_large_units(large, p), p))
    joined = components(links)

    # the least id of each set, then of each component
    own = src.select("doc_id", *ROW).join(info.dropDuplicates(list(ROW)), list(ROW))
    least = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(joined, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    per_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.join(per_root, "root").select("node", "root", "component_id")
    out = own.join(of_node, "node", "left")
    return out.select(*ROW, F.col("root").alias("_root"), "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_jaccard_groups(docs: DataFrame, params: JaccardParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_shingles`` and ``component_id``, the least id its links reach.

    Two rows link when the Jaccard similarity of their shingle sets is at least num/den, decided exactly.  Null, empty
    and blank texts have no shingles and link with nothing; texts of fewer words than a shingle are one shingle; repeated
    rows link like any equal texts.  A row with a null id takes part, and where all ids of a component are null so is its
    ``component_id``.  Extra columns are ignored.  An empty table gives an empty result.
    """
    return _groups(docs, params, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, params: JaccardParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of near copies; columns stay as they are, whatever their names.

    The row of the least id stays (null ids behind all), of those that share it the one with the least hash of its text,
    and of rows that repeat an id and a text one.  Rows without words all stay.  An empty table gives an empty result.
    """
    groups = written(_groups(docs, params, id_col, text_col).where("_root is not null").select(*ROW, "_root", F.col("doc_id").alias("_id")), "op1")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), *ROW)
    first = groups.groupBy("_root").agg(F.min(place).alias("p")).select("_root", *[F.col(f"p.{k}").alias(f"{k}_first") for k in ROW])
    stays = F.lit(True)
    for k in ROW:
        stays = stays & (F.col(k) == F.col(f"{k}_first"))
    # a row's hashes, whether it is its group's first, and how often it is there
    rows = groups.groupBy(*ROW, "_root").agg(F.count("*").alias("times"))
    judged = written(rows.join(first, "_root").select(*ROW, stays.alias("stays"), "times").where("not stays or times > 1"), "op1")
    keyed = may_be_in(docs.select(struct_of(docs), *row_key(id_col, text_col)), judged)
    # most rows are not judged at all, and stay where they are
    keyed, out = keyed.where("_may"), keyed.where("not _may").select("_row")
    out = out.unionByName(keyed.join(judged.hint("shuffle_hash"), list(ROW), "left_anti").select("_row"))
    if judged.where("stays").limit(1).count():
        # of rows that repeat an id and a text one stays: they are put together map-side
        again = keyed.join(judged.where("stays").hint("shuffle_hash"), list(ROW), "left_semi")
        out = out.unionByName(again.groupBy(*ROW).agg(F.first("_row").alias("_row")).select("_row"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
