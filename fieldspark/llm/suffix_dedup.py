"""Removal of repeated passages by suffix arrays and longest-previous-factor arrays.

A window is a string of ``length`` bytes.  Windows never cross documents.

1. Anchors: a window's anchor is its ``gram``-byte string with the least hash, the
   leftmost if several.  Equal windows have the same anchor at the same offset, so a
   repeat always shows as an anchor that occurs twice.  Neighbouring windows with one
   anchor form its context, and every window belongs to one context only.
2. Anchors are counted by hash, and by context hash, combined map-side.
3. Bytes meet where they are compared.  If the contexts of a repeated anchor differ in
   their hashes, each distinct one gives its bytes once, dealt out by anchor.  If they
   are all alike, the first and the last of them do: neighbouring ones of the same two
   documents, which overlap, are one stretch of either, dealt out together.
4. Within a chunk the contexts or stretches are joined, a suffix array is built, and the
   longest previous factor of every position follows from its previous and next smaller
   positions in suffix order: a window with a factor of ``length`` bytes has an earlier
   copy, and the position it points at is that copy.  An anchor of differing contexts
   with too many occurrences for one task gives the hashes of its windows instead,
   combined in each batch before they are dealt out, which spreads it.
5. The covered stretches come back to their texts by row key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import ROW, U64, buckets_of, discard, documents_of, lean, mix, pack_buckets, partitions, rolling, row_key, text_bytes, unpack, written

PACKED = "bucket int, kind int, n int, blob binary"
#: Symbols of nine bits in the first rank of a suffix; and where contexts of a stretch are cut, in bytes.
FIRST_RANK = 7
STRETCH = 65_536
LEAD, TAIL, ODD = 0, 1, 2


@dataclass(frozen=True)
class RepeatParams:
    """``keep``: "none" removes every copy of a repeat, "first" all but the first by (id, position)."""

    length: int = 200
    gram: int = 32
    keep: str = "none"
    hot: int = 4000
    chunk: int = 600_000
    block: int = 10_000

    def __post_init__(self):
        if not 1 <= self.gram <= self.length or self.length < FIRST_RANK:
            raise ValueError(f"gram must lie between 1 and length, which is {FIRST_RANK} at least")
        if self.keep not in ("none", "first"):
            raise ValueError("keep is 'none' or 'first'")

    @property
    def reach(self) -> int:
        return self.length - self.gram


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every ``w`` neighbours, by doubling."""
    span = 1
    while span * 2 <= w:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(text: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each context of a text: the anchor's hash, the context's hash, where it begins, and its size in bytes."""
    n = len(text)
    if n < p.length:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    roll = rolling(0x2545F491)
    prefix = roll.prefix(text)
    gram = (prefix[p.gram :] - prefix[: -p.gram]) * roll.inv_power[: n - p.gram + 1]
    order = gram ^ (gram >> U64(29))
    order *= U64(0xD6E8FEB86659FD93)
    # high half: the hash; low half: the position, so that the leftmost of equals is least
    order &= U64(0xFFFFFFFF00000000)
    order |= np.arange(len(order), dtype=U64)
    low = _sliding(order, p.reach + 1, np.minimum)
    begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    size = np.diff(np.r_[begin, len(low)]) - 1 + p.length
    at = (low[begin] & U64(0xFFFFFFFF)).astype(np.int64)
    context = mix(roll.spans(prefix, begin, begin + size) + (at - begin).astype(U64) * U64(0x9E3779B97F4A7C15))
    return mix(gram[at]), context, begin, size


def _anchor_pass(p: RepeatParams, n_keys: int):
    """Rows of (h, c, lo, size) and the ``n_keys`` first columns of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], []
            for i, text in enumerate(documents_of(batch)):
                found = anchors(text, p)
                if len(found[0]):
                    parts.append(found)
                    rows.append(np.full(len(found[0]), i, np.int64))
            if not parts:
                continue
            h, c, lo, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = pa.array(np.concatenate(rows))
            cols = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, *[batch.column(k).take(row) for k in range(n_keys)]], ["h", "c", "lo", "size", *batch.schema.names[:n_keys]])

    return run


# --------------------------------------------------------------------------- suffix order


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first ``depth`` symbols at least, and the ranks of each doubling (for prefix matches).

    ``symbols`` are bytes and separators as int64 below 511; ``FIRST_RANK`` of them make up the first rank.
    """
    n = len(symbols)
    padded = np.concatenate([symbols + 1, np.zeros(FIRST_RANK, np.int64)])
    key = padded[:n] << 9 * (FIRST_RANK - 1)
    for i in range(1, FIRST_RANK):
        key |= padded[i : n + i] << 9 * (FIRST_RANK - 1 - i)
    ranks, span = [], FIRST_RANK
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        ranks.append(rank)
        if span >= depth or (n and rank[order[-1]] == n - 1):
            return order, ranks
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - span)] = rank[span:] + 1
        key = rank * np.int64(n + 1) + nxt
        span *= 2


def previous_factors(order: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the nearest smaller positions before and after it in suffix order (-1: none).

    The smaller positions come from pointer jumping over the whole array at once: a candidate that is not smaller is
    replaced by its own candidate until all have settled.  ``same(a, b)`` tells whether neighbours in suffix order share
    a factor; a jump never leaves a run of neighbours that do, which is all that longest-factor queries at one length need.
    """
    n = len(order)
    out = []
    for step in (-1, 1):
        near = np.arange(n) + step
        ok = (near >= 0) & (near < n)
        ok[ok] = same(order[np.flatnonzero(ok)], order[near[ok]])
        near[~ok] = -1
        todo = np.flatnonzero((near >= 0) & (order[near] > order))
        while len(todo):
            near[todo] = near[near[todo]]
            at = near[todo]
            todo = todo[(at >= 0) & (order[at] > order[todo])]
        pos = np.full(n, -1, np.int64)
        pos[order] = np.where(near >= 0, order[near], -1)
        out.append(pos)
    return out[0], out[1]


def repeated_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined contexts: where each begins, and whether the window at each position has an earlier copy / any copy.

    The contexts come in the order in which copies count as earlier.
    """
    size = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    total = int(size.sum()) + len(contexts)
    symbols = np.full(total, 256, np.int64)
    text = np.ones(total, bool)
    text[begin + size] = False
    symbols[text] = np.frombuffer(b"".join(contexts), np.uint8)
    room = np.repeat(begin + size, size + 1) - np.arange(total) >= length
    order, ranks = suffix_array(symbols, length)
    spans = [FIRST_RANK << i for i in range(len(ranks))]

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        yes = room[a] & room[b]
        at, left = 0, length
        for span, rank in zip(reversed(spans), reversed(ranks), strict=True):
            while left >= span and yes.any():
                i = np.flatnonzero(yes)
                yes[i] = rank[a[i] + at] == rank[b[i] + at]
                at, left = at + span, left - span
        if left and yes.any():  # a remainder shorter than the first rank: one overlapping comparison
            i = np.flatnonzero(yes)
            yes[i] = ranks[0][a[i] + length - FIRST_RANK] == ranks[0][b[i] + length - FIRST_RANK]
        return yes

    before, after = previous_factors(order, same)
    later = (before >= 0) | (after >= 0)
    any_copy = later.copy()
    for source in (before, after):
        any_copy[source[source >= 0]] = True
    return begin, later, any_copy


# --------------------------------------------------------------------------- bytes to where they are compared


def stretch_entry(pair: int, side: int, text: np.ndarray, h: np.ndarray, lo: np.ndarray, size: np.ndarray) -> bytes:
    """One document's side of a pair: its contexts (sorted by place) merged to stretches, their bytes, and of a tail the contexts' places in them."""
    runs = merged(np.stack([lo, lo + size], 1))
    own = np.searchsorted(runs[:, 0], lo, side="right") - 1
    items = [h, own, lo - runs[own, 0], size] if side == TAIL else []
    body = b"".join([*[np.ascontiguousarray(x, np.int64).tobytes() for x in (*items, runs[:, 1] - runs[:, 0])], *[text[a:b].tobytes() for a, b in runs]])
    return np.array([pair, side, len(h) if side == TAIL else 0, len(runs), len(body)], np.int64).tobytes() + body


def stretch_entries(blob: bytes) -> Iterator[tuple[int, int, np.ndarray, list[bytes]]]:
    """(pair, side, items as rows of h, stretch, offset and size, stretches) of each entry of a blob."""
    at = 0
    while at < len(blob):
        pair, side, n, m, size = np.frombuffer(blob, np.int64, 5, at)
        at += 40
        end = at + size
        items = np.frombuffer(blob, np.int64, 4 * n, at).reshape(4, n)
        at += 32 * n
        sizes = np.frombuffer(blob, np.int64, m, at)
        at += 8 * m
        cuts = at + np.r_[0, np.cumsum(sizes)]
        yield int(pair), int(side), items, [blob[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        at = end


def _context_pass(p: RepeatParams, n_buckets: int):
    """Contexts as bytes (kind 0), for hot anchors the hashes of their windows (kinds 1 and 2), and the stretches of contexts
    that are all alike (kind 3), packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, second = rolling(0x2545F491), rolling(0x6C8E9CF5)
        for batch in batches:
            meta, blobs = [], []
            entries: list[tuple[int, bytes]] = []
            win: list[tuple[np.ndarray, ...]] = []
            wanted = batch.column(1).to_pylist()
            for text, ask in zip(documents_of(batch), wanted, strict=True):
                pre = None
                alike: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for a in ask:
                    lo, size = a["lo"], a["size"]
                    if a["side"] != ODD:
                        alike.setdefault((a["c"], a["side"]), []).append((lo, a["h"], size))
                        continue
                    if a["hot"]:
                        if pre is None:
                            pre = roll.prefix(text), second.prefix(text)
                        s = np.arange(lo, lo + size - p.length + 1)
                        win.append((roll.spans(pre[0], s, s + p.length), second.spans(pre[1], s, s + p.length), *[np.full(len(s), a[k]) for k in ("h", "c")], s - lo, *[np.full(len(s), a[k]) for k in ("ord", "rk")], s, *[np.full(len(s), a[k]) for k in ("copies", "n")]))
                    else:
                        meta.append((a["h"], a["c"], a["ord"], a["rk"], lo, size, a["copies"], a["n"]))
                        blobs.append(text[lo : lo + size].tobytes())
                for (pair, side), found in alike.items():
                    lo, h, size = np.array(sorted(found), np.int64).T
                    entries.append((pair % n_buckets, stretch_entry(pair, side, text, h, lo, size)))
            rows = []
            of: dict[int, list[bytes]] = {}
            for b, e in entries:
                of.setdefault(b, []).append(e)
            rows += [(b, 3, len(e), b"".join(e)) for b, e in of.items()]
            if meta:
                m = np.array(meta, np.int64)
                bucket = (np.ascontiguousarray(m[:, 0]).view(U64) % U64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    i = order[x:y]
                    rows.append((int(bucket[i[0]]), 0, len(i), m[i].tobytes() + b"".join(blobs[j] for j in i)))
            if win:
                rows += _local_windows(*(np.concatenate(x) for x in zip(*win, strict=True)), p=p, n_buckets=n_buckets)
            if rows:
                b, k, n, blob = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "n", "blob"])

    return run


def _window_runs(w1, w2, order_by):
    """Rows sorted by window and order; the first row of each window."""
    order = np.lexsort((*order_by, w2, w1))
    a, b = w1[order], w2[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first


def _once(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows whose (h, c, offset), the third to fifth column, came before are left out: rows that repeat an id and a text ship their contexts each."""
    h, c, off = columns[2:5]
    order = np.lexsort((off, c, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]) | (off[order][1:] != off[order][:-1])
    return [x[order[new]] for x in columns]


def _local_windows(*windows: np.ndarray, p: RepeatParams, n_buckets: int):
    """Combine a batch's windows: kind 2 answers what the batch itself shows, kind 1 forwards one row a window."""
    rows = []
    w1, w2, h, c, off, ord_, rk, pos, copies, many = _once(*windows)
    order, first = _window_runs(w1, w2, (pos, rk, ord_))
    group = np.cumsum(first) - 1
    times = np.bincount(group, copies[order] if p.keep == "none" else None)
    known = (times[group] > 1) if p.keep == "none" else ~first
    if known.any():
        i = order[known]
        rows += [(b, 2, n, blob) for b, n, blob in pack_buckets(((h[i] ^ c[i]).view(U64) % U64(n_buckets)).astype(np.int64), h[i], c[i], off[i], many[i])]
    i = order[first]
    more = (times > 1).astype(np.int64)
    rows += [(b, 1, n, blob) for b, n, blob in pack_buckets((w1[i] % U64(n_buckets)).astype(np.int64), w1[i], w2[i], h[i], c[i], off[i], ord_[i], rk[i], pos[i], more, many[i])]
    return rows


#: ``n`` of -1: contexts of the anchor that look alike and are not.
_HIT = "h long, c long, lo int, hi int, n long"


def _hits(h: np.ndarray, c: np.ndarray, off: np.ndarray, many: np.ndarray, p: RepeatParams) -> pa.RecordBatch:
    """One row per context: the stretch of it that its repeated windows cover (they all hold the anchor)."""
    order = np.lexsort((off, c, h))
    h, c, off, many = h[order], c[order], off[order], many[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(h)] - 1
    return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(c[at]), pa.array(off[at].astype(np.int32)), pa.array((off[last] + p.length).astype(np.int32)), pa.array(many[at])], ["h", "c", "lo", "hi", "n"])


def _factor_pass(p: RepeatParams):
    def contexts(meta: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch | None:
        # the one order in which copies count as earlier: id, then text, then position
        order = np.lexsort((meta[:, 4], meta[:, 3], meta[:, 2]))
        meta, blobs = meta[order], [blobs[i] for i in order]
        begin, later, any_copy = repeated_windows(blobs, p.length)
        found = []
        flag = later if p.keep == "first" else any_copy
        for at, (h, c, _, _, _, size, copies, n) in zip(begin, meta, strict=True):
            starts = size - p.length + 1
            hit = (0, starts - 1) if copies > 1 and p.keep == "none" else np.flatnonzero(flag[at : at + starts])
            if len(hit):
                found.append((h, c, hit[0], hit[-1] + p.length, n))
        if not found:
            return None
        f = np.array(found, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2].astype(np.int32)), pa.array(f[:, 3].astype(np.int32)), pa.array(f[:, 4])], ["h", "c", "lo", "hi", "n"])

    def alike(pairs: list[dict]) -> pa.RecordBatch | None:
        """Anchors one of whose windows has no earlier copy after all: the first and the last of contexts that look alike differ."""
        texts, items = [], []
        for pair in pairs:
            texts += pair.get(LEAD, (None, []))[1]
            if TAIL in pair:
                items.append((pair[TAIL][0], len(texts)))
                texts += pair[TAIL][1]
        if not items:
            return None
        begin, later, _ = repeated_windows(texts, p.length)
        missing = np.concatenate([[0], np.cumsum(~later)])
        wrong = []
        for (h, stretch, offset, size), base in items:
            at = begin[base + stretch] + offset
            wrong.append(h[missing[at + size - p.length + 1] > missing[at]])
        h = np.concatenate(wrong)
        if not len(h):
            return None
        zero = pa.array(np.zeros(len(h), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(h), zero, zero, pa.array(np.full(len(h), -1, np.int64))], ["h", "c", "lo", "hi", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in buckets_of(batches):
            meta, blobs, win = [], [], []
            pairs: dict[int, dict] = {}
            for kind, n, blob in held:
                if kind == 3:
                    for pair, side, items, texts in stretch_entries(blob):
                        pairs.setdefault(pair, {})[side] = (items, texts)
                    continue
                if kind == 0:
                    m = np.frombuffer(blob, np.int64, n * 8).reshape(n, 8)
                    ends = np.cumsum(m[:, 5]) + n * 64
                    meta.append(m)
                    blobs += [blob[e - s : e] for s, e in zip(m[:, 5], ends, strict=True)]
                elif kind == 2:
                    yield _hits(*unpack(n, blob, *[np.int64] * 4), p)
                else:
                    win.append(unpack(n, blob, U64, U64, *[np.int64] * 8))
            chunk, size = [], 0
            for pair in pairs.values():
                chunk.append(pair)
                size += sum(len(t) for _, texts in pair.values() for t in texts)
                if size > p.chunk:
                    if (out := alike(chunk)) is not None:
                        yield out
                    chunk, size = [], 0
            if chunk and (out := alike(chunk)) is not None:
                yield out
            if meta:
                m = np.concatenate(meta)
                order = np.lexsort((m[:, 1], m[:, 0]))
                # a context that came twice (of rows that repeat an id and a text) is looked at once
                order = order[np.r_[True, (m[order[1:], :2] != m[order[:-1], :2]).any(1)]]
                # chunks end between anchors, so all contexts of an anchor meet; an anchor has at most ``hot`` of them
                size = np.cumsum(m[order, 5] + 1)
                h = m[order, 0]
                edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
                lo = 0
                while lo < len(edge) - 1:
                    base = size[edge[lo] - 1] if edge[lo] else 0
                    hi = lo + 1
                    while hi < len(edge) - 1 and size[edge[hi + 1] - 1] - base <= p.chunk:
                        hi += 1
                    i = order[edge[lo] : edge[hi]]
                    if (out := contexts(m[i], [blobs[j] for j in i])) is not None:
                        yield out
                    lo = hi
            if win:
                w1, w2, h, c, off, ord_, rk, pos, more, many = _once(*(np.concatenate(x) for x in zip(*win, strict=True)))
                order, first = _window_runs(w1, w2, (pos, rk, ord_))
                group = np.cumsum(first) - 1
                if p.keep == "first":
                    hit = ~first
                else:
                    hit = np.bincount(group, 1 + more[order])[group] > 1
                if hit.any():
                    i = order[hit]
                    yield _hits(h[i], c[i], off[i], many[i], p)

    return run


# --------------------------------------------------------------------------- covered stretches of every row


def repeated_stretches(src: DataFrame, p: RepeatParams) -> DataFrame:
    """``src(_rk, _rk2, ord, _rest, _text)`` to ``(_rk, _rk2, stretches)``: arrays of (lo, hi) byte offsets, one per anchor, unmerged.

    ``_rest`` only rides along, so that this and the caller's join on the row's hashes share one exchange of the texts.
    """
    spark = src.sparkSession
    n = partitions(spark)
    first = p.keep == "first"
    keys = ["ord", *ROW] if first else list(ROW)
    place = F.struct(*keys, "lo")
    marks = src.select(*keys, F.col("_text").alias("text")).mapInArrow(lean(_anchor_pass(p, len(keys))), "h long, c long, lo int, size int, " + ", ".join(f"{k} long" for k in keys))
    marks = written(marks, "op3")
    measures = [F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")]
    if first:
        measures.append(F.min(place).alias("lead"))
    count = marks.groupBy("h").agg(*measures).where("n > 1").withColumn("even", F.col("c0") == F.col("c1")).drop("c0", "c1")
    # written, so that both sides of the join are plain exchanges and Spark can split an anchor with very many rows
    count = written(count, "op3")
    again = marks.join(count.hint("shuffle_hash"), "h")
    if first:
        again = again.withColumn("is_first", F.col("lead") == place).drop("lead")
    again = written(again, "op3")
    discard(marks, count)

    even = again.where("even and not is_first") if first else again.where("even")
    stretch = lambda lo, hi: F.struct((F.col("lo") + lo).alias("lo"), (F.col("lo") + hi).alias("hi")).alias("s")
    odd = again.where("not even")
    # of contexts that are all alike the first and the last, by pair of documents and the distance between them
    ends = again.where("even").groupBy("h").agg(F.min(place).alias("lead"), F.max(place).alias("tail"), F.max("size").alias("size"), F.max("n").alias("n"))
    ends = ends.withColumn("pair", F.shiftrightunsigned(F.xxhash64(*[f"{e}.{k}" for e in ("lead", "tail") for k in ROW], F.col("tail.lo") - F.col("lead.lo"), F.floor(F.col("lead.lo") / STRETCH)), 1))
    no = F.lit(False)
    side = lambda e, which: ends.select(*[F.col(f"{e}.{k}").alias(k) for k in ROW], F.struct("h", F.col("pair").alias("c"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("rk"), f"{e}.lo", "size", F.lit(2).cast("long").alias("copies"), "n", no.alias("hot"), F.lit(which).alias("side")).alias("a"))
    one = odd.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct(*keys, "lo", "size", "n")).alias("r"))
    ask = one.select(*[F.col(f"r.{k}").alias(k) for k in ROW], F.struct("h", "c", F.col(f"r.{keys[0]}").alias("ord"), F.col("r._rk").alias("rk"), "r.lo", "r.size", "copies", "r.n", (F.col("r.n") > p.hot).alias("hot"), F.lit(ODD).alias("side")).alias("a"))
    ask = ask.unionByName(side("lead", LEAD)).unionByName(side("tail", TAIL))
    ask = ask.groupBy(*ROW).agg(F.collect_list("a").alias("ask"))
    text_of = src.join(ask.hint("shuffle_hash"), list(ROW)).select(F.col("_text").alias("text"), "ask", "ord", "_rest")
    packed = text_of.mapInArrow(lean(_context_pass(p, 4 * n)), PACKED)
    hits = written(packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_factor_pass(p)), _HIT), "op3")
    unlike = hits.where("n < 0").select("h").distinct()
    if unlike.limit(1).count():
        even = even.join(unlike, "h", "left_anti")
    whole = even.select(*ROW, stretch(F.lit(0), F.col("size")))
    hits = hits.where("n >= 0").groupBy("h", "c").agg(F.min("lo").alias("dlo"), F.max("hi").alias("dhi"), F.max("n").alias("n"))
    # both sides know how often the anchor occurs: its rows go to as many places as they make blocks
    slots = F.greatest(F.ceil(F.col("n") / p.block), F.lit(1)).cast("long")
    dealt = lambda d: d.withColumn("slot", F.pmod(F.xxhash64(*ROW, "lo"), slots)).drop("n")
    copied = lambda d: d.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1))).drop("n")
    part = dealt(odd).join(copied(hits), ["h", "c", "slot"]).select(*ROW, stretch(F.col("dlo"), F.col("dhi")))
    if first:
        # copies of a whole context after its first are covered entirely
        lead = copied(one.select("h", "c", F.struct(*[f"r.{k}" for k in keys], "r.lo").alias("lead"), "r.n"))
        copy = dealt(odd).join(lead, ["h", "c", "slot"]).where(F.col("lead") != place)
        part = part.unionByName(copy.select(*ROW, stretch(F.lit(0), F.col("size"))))
    return whole.unionByName(part).groupBy(*ROW).agg(F.collect_list("s").alias("stretches"))


def merged(s: np.ndarray) -> np.ndarray:
    """Maximal runs of the (lo, hi) rows."""
    if len(s) == 0:
        return np.zeros((0, 2), np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    top = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > top[:-1]]
    at = np.flatnonzero(new)
    return np.stack([s[at, 0], top[np.r_[at[1:], len(s)] - 1]], 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    col = batch.column(batch.schema.get_field_index("stretches"))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten()
    pairs = np.stack([np.asarray(flat.field(0)), np.asarray(flat.field(1))], 1).astype(np.int64) if len(flat) else np.zeros((0, 2), np.int64)
    size = np.asarray(col.value_lengths().fill_null(0))
    end = np.cumsum(size)
    for text, k, e in zip(documents_of(batch, "_text"), size, end, strict=True):
        yield text, merged(pairs[e - k : e]) if k else np.zeros((0, 2), np.int64)


def _digest_pass():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, sha = [], [], [], []
            for text, runs in _runs(batch):
                d, at = hashlib.sha256(), 0
                for lo, hi in runs:
                    d.update(text[at:lo])
                    at = hi
                d.update(text[at:])
                size.append(len(text))
                removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
                spans.append(len(runs))
                sha.append(d.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["_rest", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _text_pass(schema_names: list[str]):
    """Remaining text; a run gives up bytes at its ends that would cut a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            null = text_bytes(batch.column(batch.schema.get_field_index("_text")))[2]
            for (text, runs), none in zip(_runs(batch), null, strict=True):
                parts, at = [], 0
                for lo, hi in runs:
                    while lo < hi and text[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
                        hi -= 1
                    parts.append(text[at:lo].tobytes())
                    at = hi
                parts.append(text[at:].tobytes())
                texts.append(None if none else b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema_names)

    return run


def _with_stretches(docs: DataFrame, p: RepeatParams, rest: list[str], id_col: str, text_col: str) -> DataFrame:
    src = docs.select(
        *row_key(id_col, text_col),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("ord"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"),
        F.col(text_col).alias("_text"),
    )
    joined = src.join(repeated_stretches(src, p).hint("shuffle_hash"), list(ROW), "left")
    return joined.select("_rest", "_text", "stretches", "ord")


def repeat_digest(docs: DataFrame, params: RepeatParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_bytes, bytes removed, maximal removed runs, and the SHA-256 of what remains.

    Null and empty texts have no bytes (the digest of nothing).  Rows that repeat an id and a text are copies of each
    other.  Null ids are allowed.  Extra columns are ignored; an empty table gives an empty result.
    """
    p = params or RepeatParams()
    rows = _with_stretches(docs, p, [id_col], id_col, text_col)
    schema = f"_rest struct<{id_col}:{docs.schema[id_col].dataType.simpleString()}>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = rows.mapInArrow(lean(_digest_pass()), schema)
    return out.select(F.col(f"_rest.`{id_col}`").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, params: RepeatParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text (by default the first copy stays); rows and columns stay.

    The first copy is that of the least id (null ids before all), then of the least hash of the text, then of the least
    position.  Rows that repeat an id and a text are one document here and keep the same text, so one whole copy of every
    passage is left.  A null text stays null; an empty table gives an empty result.
    """
    p = params or RepeatParams(keep="first")
    rows = _with_stretches(docs, p, [c for c in docs.columns if c != text_col], id_col, text_col)
    schema = rows.select("_rest", F.col("_text").alias("_new")).schema
    out = rows.mapInArrow(lean(_text_pass(["_rest", "_new"])), schema)
    return out.select(*[F.col("_new").alias(text_col) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
