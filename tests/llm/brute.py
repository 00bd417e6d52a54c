"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, words: int) -> set[tuple[str, ...]]:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    m = min(words, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}


def jaccard_groups(docs: list[tuple[int, str | None]], words: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least id reached)."""
    sets = [(d, shingles(t, words)) for d, t in docs]
    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, s) in enumerate(sets):
        both = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets)}


def repeat_masks(texts: list[bytes], length: int, keep: str) -> list[list[bool]]:
    """Bytes of each text (in order) covered by repeated windows."""
    seen = defaultdict(list)
    for i, b in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]].append((i, s))
    out = [[False] * len(b) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places[1 if keep == "first" else 0 :]:
                out[i][s : s + length] = [True] * length
    return out


def repeat_digest(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    texts = [(t or "").encode() for _, t in docs]
    out = {}
    for (d, _), b, m in zip(docs, texts, repeat_masks(texts, length, "none"), strict=True):
        spans = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        out[d] = (len(b), sum(m), spans, hashlib.sha256(bytes(x for x, gone in zip(b, m, strict=True) if not gone)).hexdigest())
    return out


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)
