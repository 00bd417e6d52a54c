"""Quality classification by co-training.

Two views of a document: its text (hashed words and exact text ratios) and its page
metadata (language, source, recorded length).  Each view has a logistic regression.
Round by round each view scores every unlabelled document there is and hands those it
is surest of to the other view.  Labelled documents kept back calibrate each view
(Platt), and the calibrated log-odds add up, less the prior counted twice.

The views of all documents are made once and written: the words as bits, 288 bytes a
document.  A round is a pass over that table; each task keeps its surest few, those
meet in a merging top list, and only the documents handed over reach the driver.
Labelled documents are a sample of at most ``max_labelled`` by hash of the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import U64, ascii_lower, discard, documents_of, mix, rolling, word_spans, written
from fieldspark.llm.quality_rules import text_counts

N_RATIOS = 8
N_PLACES = 4


@dataclass(frozen=True)
class CoTrainParams:
    """Bound of the labelled sample, hashed places of words (a multiple of 8) and metadata, rounds, documents handed over a round by each view and label, keep threshold."""

    max_labelled: int = 4000
    words: int = 2048
    meta: int = 256
    rounds: int = 4
    handed: int = 150
    sure: float = 0.95
    ridge: float = 1e-3
    threshold: float = 0.5


def text_view(b: np.ndarray, p: CoTrainParams) -> tuple[bytes, bytes]:
    """Presence of hashed words as packed bits, and ratios of the exact counts (single precision)."""
    seen = np.zeros(p.words, np.uint8)
    ratios = np.zeros(N_RATIOS, np.float32)
    start, end = word_spans(b)
    if len(start) == 0:
        ratios[0] = 1
        return np.packbits(seen).tobytes(), ratios.tobytes()
    roll = rolling(0x7F4A7C15)
    h = roll.spans(roll.prefix(ascii_lower(b)), start, end)
    seen[(mix(h) >> U64(40)).astype(np.int64) % p.words] = 1
    n, chars, symbols, dup, repeat, lines = text_counts(b)
    upper = np.count_nonzero((b >= 65) & (b <= 90))
    ratios[:] = (0, np.log1p(n) / 8, chars / n / 10, min(1.0, symbols / max(chars, 1) * 4), dup / max(lines, 1), repeat / n, upper / max(len(b), 1) * 4, len(np.unique(h)) / n)
    return np.packbits(seen).tobytes(), ratios.tobytes()


@lru_cache(maxsize=1 << 14)
def _place(kind: str, value: str, places: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % places


def meta_view(lang: str | None, source: str | None, n_chars: int | None, p: CoTrainParams) -> tuple[int, int, int, int]:
    """Places of the language, the source and their pair, and the step of the recorded length."""
    step = 11 if n_chars is None or n_chars < 0 else min(10, int(np.log2(n_chars + 1) // 1.6))
    return _place("l", str(lang), p.meta), _place("s", str(source), p.meta), _place("ls", f"{lang}\x00{source}", p.meta), p.meta + step


def dense_text(bits: list[bytes], ratios: list[bytes], p: CoTrainParams) -> np.ndarray:
    """Text views as rows: the words present, scaled to unit length, and the ratios."""
    out = np.empty((len(bits), p.words + N_RATIOS), np.float32)
    out[:, : p.words] = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).reshape(len(bits), p.words)
    out[:, : p.words] /= np.sqrt(np.maximum(out[:, : p.words].sum(1, keepdims=True), 1))
    out[:, p.words :] = np.frombuffer(b"".join(ratios), np.float32).reshape(len(bits), N_RATIOS)
    return out


def dense_meta(places: list[bytes], p: CoTrainParams) -> np.ndarray:
    out = np.zeros((len(places), p.meta + 12), np.float32)
    at = np.frombuffer(b"".join(places), np.int32).reshape(len(places), N_PLACES)
    out[np.arange(len(places))[:, None], at] = 1
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, start: np.ndarray | None = None, steps: int = 120) -> np.ndarray:
    """Ridge logistic regression (last weight: intercept) by accelerated gradient steps, classes weighted alike.

    Products stay in single precision; the step size comes from the largest eigenvalue by power iteration.
    """
    x = x.astype(np.float32, copy=False)
    n = max(len(y), 1)
    share = max(float(y.mean()), 1e-6) if len(y) else 0.5
    weight = (np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6)) / n).astype(np.float32)

    def forward(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1].astype(np.float32) + np.float32(v[-1])

    def back(r: np.ndarray) -> np.ndarray:
        r = r.astype(np.float32)
        return np.r_[r @ x, r.sum()].astype(np.float64)

    v, top = np.ones(x.shape[1] + 1), 1.0
    for _ in range(15):
        v = back(weight * forward(v / np.linalg.norm(v)))
        top = float(np.linalg.norm(v))
    step = 1 / (0.3 * top + ridge)
    w = v = np.zeros(x.shape[1] + 1) if start is None else start
    for t in range(steps):
        grad = back(weight * (_sigmoid(forward(v)) - y)) + ridge * np.r_[v[:-1], 0]
        nxt = v - step * grad
        v = nxt + t / (t + 3) * (nxt - w)
        w = nxt
    return w


def fit_platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into calibrated log-odds (Newton steps, smoothed targets)."""
    up, down = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    scale = max(float(np.abs(score).max(initial=0)), 1e-9)
    s = score / scale
    for _ in range(50):
        q = _sigmoid(a * s + b)
        g = np.array([((q - target) * s).sum() + 1e-3 * a, (q - target).sum()])
        r = q * (1 - q)
        hess = np.array([[(r * s * s).sum() + 1e-3, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return a / scale, b


@dataclass
class QualityModel:
    params: CoTrainParams
    text: np.ndarray = field(repr=False)
    meta: np.ndarray = field(repr=False)
    text_platt: tuple[float, float]
    meta_platt: tuple[float, float]
    prior: float

    def log_odds(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.text_platt[0] * (text @ self.text[:-1] + self.text[-1]) + self.text_platt[1]
        m = self.meta_platt[0] * (meta @ self.meta[:-1] + self.meta[-1]) + self.meta_platt[1]
        return t, m, t + m - self.prior


class Learner:
    """Both views between rounds.  Every fourth labelled row is kept back for calibration; the others start both views."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, p: CoTrainParams):
        back = np.arange(len(y)) % 4 == 3
        self.p, self.y = p, y
        self.held_y = y[back]
        self.held = [text[back], meta[back]]
        self.taught = [[(text[~back], y[~back].astype(float))], [(meta[~back], y[~back].astype(float))]]
        self.weights = [self._fit(v, None, 120) for v in (0, 1)]

    def _fit(self, view: int, start: np.ndarray | None, steps: int) -> np.ndarray:
        x, y = zip(*self.taught[view], strict=True)
        return fit_logistic(np.concatenate(x), np.concatenate(y), self.p.ridge, start, steps)

    def platt(self) -> list[tuple[float, float]]:
        return [fit_platt(h @ w[:-1] + w[-1], self.held_y) for h, w in zip(self.held, self.weights, strict=True)]

    def model(self) -> QualityModel:
        up, down = float((self.y == 1).sum()), float((self.y == 0).sum())
        t, m = self.platt()
        return QualityModel(self.p, self.weights[0].astype(np.float32), self.weights[1].astype(np.float32), t, m, float(np.log((up + 1) / (down + 1))))

    def take(self, view: int, x: np.ndarray, label: np.ndarray) -> None:
        if len(label):
            self.taught[view].append((x, label.astype(float)))

    def refit(self) -> None:
        self.weights = [self._fit(v, self.weights[v], 60) for v in (0, 1)]


# --------------------------------------------------------------------------- views of a table

VIEWS = "doc_id long, h1 long, h2 long, bits binary, ratios binary, places binary"


def _view_pass(p: CoTrainParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [text_view(t, p) for t in documents_of(batch)]
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "n_chars")]
            places = [np.array(meta_view(*r, p), np.int32).tobytes() for r in zip(*cols, strict=True)]
            made = [pa.array([t[0] for t in text], pa.binary()), pa.array([t[1] for t in text], pa.binary()), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc_id", "h1", "h2", "bits", "ratios", "places"])

    return run


def quality_views(docs: DataFrame, params: CoTrainParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both views of every row, written: what ``fit_quality`` and ``score_quality`` read, so that texts are read once.

    ``h1`` and ``h2`` are hashes of all that the views are made of; rows with the same content have the same.
    """
    p = params or CoTrainParams()
    lang, source, n_chars, text = F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"), F.col(text_col)
    content = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in (lang, source, n_chars, text)]
    h1, h2 = F.xxhash64(*content), F.xxhash64(F.lit(1), *reversed(content))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), lang.alias("lang"), source.alias("source"), n_chars.alias("n_chars"), text.alias("text"))
    return written(src.mapInArrow(_view_pass(p), VIEWS), "op4")


def _is_views(df: DataFrame) -> bool:
    return df.columns == ["doc_id", "h1", "h2", "bits", "ratios", "places"]


def _dense(batch: pa.RecordBatch, p: CoTrainParams) -> tuple[np.ndarray, np.ndarray]:
    bits, ratios, places = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bits", "ratios", "places"))
    return dense_text(bits, ratios, p), dense_meta(places, p)


def _score_pass(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                scores = [pa.array(_sigmoid(v.astype(np.float64))) for v in model.log_odds(*_dense(batch, model.params))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *scores], ["doc_id", "score_text", "score_meta", "score"])

    return run


#: ``kind`` is 2 * (view that hands over) + label.
SUREST = "kind int, sure double, h1 long, h2 long, bits binary, ratios binary, places binary"


def surest(kind: int, sure: np.ndarray, h1: np.ndarray, h2: np.ndarray, taken: set, p: CoTrainParams) -> np.ndarray:
    """Rows of at least ``p.sure``, surest first, ties by content; one row a content, none of ``taken``, at most ``p.handed``."""
    i = np.flatnonzero(sure >= p.sure)
    i = i[np.lexsort((h2[i], h1[i], -sure[i]))]
    out, met = [], set()
    for j in i:
        key = (int(h1[j]), int(h2[j]))
        if key not in taken and key not in met:
            met.add(key)
            out.append(j)
            if len(out) == p.handed:
                break
    return np.array(out, np.int64)


def _surest_pass(model: QualityModel, taken: list[set]):
    """Of a task's unlabelled rows the surest of each view and label; ``taken[view]`` went to that view already."""
    p = model.params

    def best(kind: int, rows: list) -> list:
        if not rows:
            return rows
        sure, h1, h2 = (np.array([r[k] for r in rows]) for k in range(3))
        return [rows[j] for j in surest(kind, sure, h1, h2, taken[1 - kind // 2], p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[], [], [], []]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                odds = model.log_odds(*_dense(batch, p))
                h1, h2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
                blobs = [batch.column(batch.schema.get_field_index(c)) for c in ("bits", "ratios", "places")]
                for view in (0, 1):
                    # rounded, so that the order does not hang on how rows fall into batches
                    prob = np.round(_sigmoid(odds[view].astype(np.float64)), 6)
                    for label in (0, 1):
                        kind = 2 * view + label
                        sure = prob if label else 1 - prob
                        at = surest(kind, sure, h1, h2, taken[1 - view], p)
                        kept[kind] = best(kind, kept[kind] + [(sure[j], int(h1[j]), int(h2[j]), *[c[int(j)].as_py() for c in blobs]) for j in at])
        rows = [(k, *r) for k, own in enumerate(kept) for r in own]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "sure", "h1", "h2", "bits", "ratios", "places"])

    return run


def _handed(pool: DataFrame, model: QualityModel, taken: list[set]) -> list:
    """The surest documents of each kind over the whole pool: top lists by task, then by slot of content, then by kind."""
    found = pool.mapInArrow(_surest_pass(model, taken), SUREST).dropDuplicates(["kind", "h1", "h2"])
    order = [F.desc("sure"), "h1", "h2"]
    by_slot = Window.partitionBy("kind", F.pmod("h1", F.lit(64))).orderBy(*order)
    found = found.withColumn("_r", F.row_number().over(by_slot)).where(F.col("_r") <= model.params.handed)
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("_r") <= model.params.handed)
    return found.orderBy("kind", "_r").collect()


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, p: CoTrainParams, surest_of) -> QualityModel:
    """``surest_of(model, taken)`` gives the rows (kind, sure, h1, h2, bits, ratios, places) that the views hand over."""
    learner = Learner(text, meta, y, p)
    taken: list[set] = [set(), set()]
    for _ in range(p.rounds):
        rows = surest_of(learner.model(), taken)
        if not rows:
            break
        for view in (0, 1):
            mine = [r for r in rows if 1 - r[0] // 2 == view and (r[2], r[3]) not in taken[view]]
            # a document handed over with both labels goes by the surer one, then by label 0
            mine = sorted({(r[2], r[3]): r for r in sorted(mine, key=lambda r: (r[1], -r[0]))}.values(), key=lambda r: (r[0], -r[1], r[2], r[3]))
            if mine:
                taken[view] |= {(r[2], r[3]) for r in mine}
                x = dense_meta([bytes(r[6]) for r in mine], p) if view else dense_text([bytes(r[4]) for r in mine], [bytes(r[5]) for r in mine], p)
                learner.take(view, x, np.array([r[0] % 2 for r in mine]))
        learner.refit()
    return learner.model()


def fit_quality(docs: DataFrame, labels: DataFrame, params: CoTrainParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """Fit on ``labels(doc_id, quality)`` and all unlabelled rows; None where no document or only one class is labelled.

    ``docs`` are documents or their ``quality_views``.  An id whose labels contradict each other is labelled good; of
    rows that repeat a labelled id the one with the least content hash counts.  Null ids are unlabelled.  Rows of equal
    content are handed over once.
    """
    p = params or CoTrainParams()
    spark = docs.sparkSession
    views = docs if _is_views(docs) else quality_views(docs, p, id_col, text_col)
    known = written(labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y")), "op4")
    draw = F.xxhash64(F.lit(1), F.col("doc_id"))
    share = min(1.0, 1.25 * p.max_labelled / max(known.count(), 1))
    # a share by hash first, so that no task sends more than its part of the sample
    some = known.where(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    chosen = [(r["doc_id"], r["y"]) for r in some.orderBy(draw, "doc_id").limit(p.max_labelled).collect()]
    if len({y for _, y in chosen}) < 2:
        return None
    # bounded by ``max_labelled``, so the broadcast is as well
    asked = spark.createDataFrame(chosen, "doc_id long, y int")
    rows = views.join(F.broadcast(asked), "doc_id").groupBy("doc_id", "y").agg(F.min_by(F.struct("bits", "ratios", "places"), F.struct("h1", "h2")).alias("v"))
    got = sorted(rows.collect(), key=lambda r: int(mix(np.array([r["doc_id"]], np.int64).view(U64))[0]))
    y = np.array([r["y"] for r in got])
    if len(set(y)) < 2 or len(set(y[np.arange(len(y)) % 4 == 3])) < 2:
        return None
    text = dense_text([bytes(r["v"]["bits"]) for r in got], [bytes(r["v"]["ratios"]) for r in got], p)
    meta = dense_meta([bytes(r["v"]["places"]) for r in got], p)
    # null ids match no label; a key of their own spreads them
    spread = F.when(F.col("doc_id").isNull(), F.col("h1")).otherwise(F.lit(0))
    keyed = views.withColumn("_s", spread).join(known.select("doc_id", F.lit(0).cast("long").alias("_s")), ["doc_id", "_s"], "left_anti")
    pool = written(keyed.select("h1", "h2", "bits", "ratios", "places"), "op4")
    model = co_train(text, meta, y, p, lambda m, taken: _handed(pool, m, taken))
    discard(pool, known)
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score_text, score_meta, score, kept) of every row of ``docs``, documents or their ``quality_views``.

    Scores are the calibrated probabilities of good quality of each view and of both.  Without a model (nothing to learn
    from) all scores are 0.5 and every row is kept.  Null and empty texts count as texts without words, null metadata as
    a value of its own; repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
    """
    if model is None:
        half = F.lit(0.5)
        ids = F.col("doc_id" if _is_views(docs) else id_col).cast("long").alias("doc_id")
        return docs.select(ids, half.alias("score_text"), half.alias("score_meta"), half.alias("score"), F.lit(True).alias("kept"))
    views = docs if _is_views(docs) else quality_views(docs, model.params, id_col, text_col)
    out = views.mapInArrow(_score_pass(model), "doc_id long, score_text double, score_meta double, score double")
    return out.withColumn("kept", F.col("score") >= model.params.threshold)
