"""Quality rules whose thresholds follow the data.

Every document gets exact counts in one vectorised pass.  Per (language, source)
the ratios of documents that pass the base rules go into KLL quantile sketches,
which are partial aggregates that merge; groups too small to speak for themselves
take the sketch merged over their language, and that over everything.  Thresholds
are fences above (below) an outer quantile of the group, by a multiple of that
quantile's distance from the median, in the group or the wider one of its language
(a group of copies has no distance of its own); no constant takes part.  Filtering
is a join of documents with their group's thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import SPACE_BYTES, U64, documents_of, mix, rolling, word_spans, written

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SPACES = np.zeros(256, bool)
_SPACES[list(SPACE_BYTES)] = True

#: metric -> (upper fence, lower fence, outer quantile, share of ``spread``).  Up to a quarter of a group may be full of symbols;
#: most documents have no repeated lines or words at all, so only the tail of those ratios says what is usual.
METRICS = {"word_length": (True, True, 0.9, 1 / 2), "symbol_ratio": (True, False, 0.75, 1.0), "dup_line_ratio": (True, False, 0.99, 1 / 12), "repeat_ratio": (True, False, 0.99, 1 / 12)}


@dataclass(frozen=True)
class QualityParams:
    """Base rules, sketch size, least documents of a group, and how far fences lie beyond the quantiles."""

    min_words: int = 50
    max_repeat_percent: int = 50
    sketch_k: int = 400
    min_group: int = 50
    spread: float = 6.0


def text_counts(b: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of a text's bytes."""
    if len(b) == 0:
        return 0, 0, 0, 0, 0, 0
    start, end = word_spans(b)
    n = len(start)
    points = int(np.count_nonzero((b & 0xC0) != 0x80))
    chars = points - int(np.count_nonzero(_SPACES[b]))
    symbols = int(np.count_nonzero(_SYMBOLS[b]))
    if n == 0:
        return 0, 0, symbols, 0, 0, 0
    roll = rolling(0x3C6EF372)
    prefix = roll.prefix(b)
    breaks = np.flatnonzero(b == 10)
    lo, hi = np.r_[0, breaks + 1], np.r_[breaks, len(b)]
    worded = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi = lo[worded], hi[worded]
    dup = len(lo) - len(np.unique(roll.spans(prefix, lo, hi))) if len(lo) > 1 else 0
    repeat = 0
    if n > 3:
        w = roll.spans(prefix, start, end)
        tri = mix((w[:-2] * U64(0x9E3779B97F4A7C15) + w[1:-1]) * U64(0xD6E8FEB86659FD93) + w[2:])
        order = np.argsort(tri)
        s = tri[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            covered[:-2] = twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeat = int(np.count_nonzero(covered))
    return n, chars, symbols, dup, repeat, len(lo)


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    for batch in batches:
        rows = np.array([text_counts(t) for t in documents_of(batch)], np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(6)]], [*batch.schema.names[:3], *names])


def document_counts(docs: DataFrame, p: QualityParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    src = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text_col).alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    out = src.mapInArrow(_count_pass, schema)
    out = out.withColumn("base_failed", (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words")))
    ratios = {"word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words")}
    return out.withColumns({m: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0) for m, (n, d) in ratios.items()})


def _fences(metric: str, sketch: Column, wide: Column, p: QualityParams) -> dict[str, Column]:
    up, down, outer, share = METRICS[metric]
    at = F.array(F.lit(1 - outer), F.lit(0.5), F.lit(outer))
    q, w = (F.kll_sketch_get_quantile_double(s, at) for s in (sketch, wide))
    far = p.spread * share
    top = q[2] + far * F.greatest(q[2] - q[1], w[2] - w[1]) if up else F.lit(float("inf"))
    bottom = q[0] - far * F.greatest(q[1] - q[0], w[1] - w[0]) if down else F.lit(float("-inf"))
    return {f"{metric}_max": top, f"{metric}_min": bottom}


def group_thresholds(counts: DataFrame, p: QualityParams) -> DataFrame:
    """(lang, source, n, fences): one row per group, from its own sketches or the wider ones that a small group falls back to."""
    good = counts.where("not base_failed")
    sketches = [F.kll_sketch_agg_double(m, F.lit(p.sketch_k)).alias(m) for m in METRICS]
    own = written(good.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches), "op8")
    merge = [F.kll_merge_agg_double(m, F.lit(p.sketch_k)).alias(f"{m}_w") for m in METRICS]
    lang = own.groupBy("lang").agg(F.sum("n").alias("n_w"), *merge)
    whole = own.groupBy((F.col("n") * 0).alias("whole")).agg(*[F.kll_merge_agg_double(m, F.lit(p.sketch_k)).alias(f"{m}_all") for m in METRICS])
    # the sketch of everything is one row, so it may be broadcast at any scale
    joined = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang"))).select("o.*", "n_w", *[f"{m}_w" for m in METRICS]).withColumn("whole", F.col("n") * 0).join(F.broadcast(whole), "whole")
    out = {}
    for m in METRICS:
        wide = F.when(F.col("n_w") >= p.min_group, F.col(f"{m}_w")).otherwise(F.col(f"{m}_all"))
        sketch = F.when(F.col("n") >= p.min_group, F.col(m)).otherwise(wide)
        out |= _fences(m, sketch, wide, p)
    return joined.select("lang", "source", "n", *[c.alias(k) for k, c in out.items()])


def apply_quality_rules(docs: DataFrame, params: QualityParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts, ``base_failed`` and ``kept``; every row is returned once.

    Null, empty and blank texts have no words and fail the base rules.  Null languages and sources form groups of their
    own.  Repeated rows count each; ids may be null; extra columns are ignored; an empty table gives an empty result.
    A row of a group none of whose rows passes the base rules has failed them itself.
    """
    p = params or QualityParams()
    counts = written(document_counts(docs, p, id_col, text_col), "op8")
    t = group_thresholds(counts, p)
    joined = counts.alias("d").join(t.alias("t"), F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    within = F.lit(True)
    for m in METRICS:
        within = within & F.col(f"d.{m}").between(F.col(f"t.{m}_min"), F.col(f"t.{m}_max"))
    kept = F.when(F.col("d.base_failed"), False).otherwise(F.coalesce(within, F.lit(True)))
    return joined.select(*[F.col(f"d.{c}") for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], kept.alias("kept"), *[F.col(f"d.{m}") for m in METRICS])
