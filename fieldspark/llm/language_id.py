"""Language identification with string kernels.

A text's features are the character n-grams, n = 1..max_n, that it holds (presence,
not counts) in lower-cased runs of letters with one space between; the blended
spectrum kernel of two texts is the number of n-grams they share over the geometric
mean of their own numbers.  N-grams are hashed to ``dims`` places.  Landmarks are a
bounded sample of labelled documents; Nystroem features K(x, landmarks) K_mm^(-1/2)
feed a one-versus-rest kernel ridge regression, solved in closed form.  Scoring
multiplies batches of presence vectors with the landmark matrix.

Only the bounded fitting sample (documented parameters) comes to the driver, as bit
vectors; prediction covers every row and the whole of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldspark.llm.common import U64, give_back, lean

UNKNOWN = "und"
FEW = 10_000


@dataclass(frozen=True)
class LanguageParams:
    """Sample and landmarks per language; the bounds on both over all languages (of very many each gets fewer, one at least); n-grams, hashed
    places, ridge, batch."""

    per_language: int = 400
    landmarks: int = 48
    max_sample: int = 40_000
    max_landmarks: int = 2400
    max_n: int = 4
    dims: int = 1 << 13
    ridge: float = 1e-2
    batch: int = 256
    temperature: float = 0.15


_LETTERS = np.zeros(0x110000, np.uint32)
_READY = False


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, others to a space.  Built once a worker from Python's character database."""
    global _READY
    if not _READY:
        _LETTERS[:] = 32
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                _LETTERS[c] = ord(low) if len(low) == 1 else c
        _READY = True
    return _LETTERS


def presence(text: str | None, p: LanguageParams, out: np.ndarray) -> bool:
    """Set ``out`` (zeros, ``dims`` long) at the places of the text's n-grams; whether it has a letter."""
    if not text:
        return False
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[points]
    space = c == 32
    if space.all():
        return False
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # one space for each run
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    h = c
    for n in range(1, p.max_n + 1):
        if n > 1:
            h = h[:-1] * U64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if len(h) == 0:
            break
        out[((h * U64(0xD6E8FEB86659FD93) + U64(n)) >> U64(40)).astype(np.int64) % p.dims] = 1
    return True


@dataclass
class LanguageModel:
    """Landmarks, whitening and ridge weights: a few MB at most, whatever the corpus."""

    params: LanguageParams
    languages: list[str]
    landmarks: np.ndarray = field(repr=False)  # dims x m, columns of unit length
    weights: np.ndarray = field(repr=False)  # m x languages: whitening times ridge solution

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Presence rows to one-versus-rest scores."""
        if not self.languages:
            return np.zeros((len(x), 0), np.float32)
        norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ self.landmarks) / norm @ self.weights


def fit_kernel_ridge(x: np.ndarray, labels: list[str], p: LanguageParams, packed: bool = False) -> LanguageModel:
    """The model of presence rows ``x`` (0 and 1, or eight of them a byte if ``packed``) and their labels.

    Rows are spread out by blocks of ``batch``: what is held besides ``x`` is the landmarks and sums over the features.
    """
    dense = lambda rows: (np.unpackbits(rows, axis=1, count=p.dims) if packed else rows).astype(np.float32)
    length = lambda rows: np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1).astype(np.float64))
    languages = sorted(set(labels))
    place = {v: k for k, v in enumerate(languages)}
    y = np.array([place[v] for v in labels], np.int64)
    each = max(1, min(p.landmarks, p.max_landmarks // max(1, len(languages))))
    marks = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))])[: p.max_landmarks] if languages else np.zeros(0, int)
    # products of presence rows are counts, which 32 bits hold exactly
    z = dense(x[marks])
    norm = length(z)
    kernel = (z @ z.T) / (norm * norm.T)
    del z  # not held beside what the eigenvectors need
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-8 * max(value.max(initial=0.0), 1e-30)
    white = vector[:, good] / np.sqrt(value[good])
    del kernel, vector
    z = dense(x[marks])
    count = np.bincount(y, minlength=len(languages)).astype(float)
    share = len(y) / (max(len(languages), 1) * count)
    gram = p.ridge * len(y) * np.eye(white.shape[1])
    # targets are 1 for a row's own language and -1 for the others
    own = np.zeros((len(languages), white.shape[1]))
    for lo in range(0, len(y), p.batch):
        rows, k = dense(x[lo : lo + p.batch]), y[lo : lo + p.batch]
        phi = (rows @ z.T) / (length(rows) * norm.T) @ white
        balanced = share[k][:, None] * phi
        gram += phi.T @ balanced
        np.add.at(own, k, balanced)
    weights = white @ np.linalg.solve(gram, (2 * own - own.sum(0)).T)
    z *= (1 / norm).astype(np.float32)
    return LanguageModel(p, languages, z.T, weights.astype(np.float32))


def _bits_pass(p: LanguageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, bits = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.zeros(p.dims, np.uint8)
                if presence(text.as_py(), p, row):
                    label.append(lang)
                    bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(bits, pa.binary())], ["lang", "bits"])

    return run


def fit_languages(labelled: DataFrame, params: LanguageParams | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``per_language`` documents of every language there is.

    The sample is by hash of id and text, so it depends neither on order nor on partitions, and repeated or null ids are
    drawn like others; equal texts of a language count once.  Rows without a label, or whose text has no letter, teach
    nothing.  Without any labelled row the model knows no language and predicts ``und``.
    """
    p = params or LanguageParams()
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    none = LanguageModel(p, [], np.zeros((p.dims, 0), np.float32), np.zeros((0, 0), np.float32))
    if not counts:
        return none
    per = max(1, min(p.per_language, p.max_sample // len(counts)))
    # a share of each language, so that every task sends its part of a bounded sample
    rates = labelled.sparkSession.createDataFrame([(k, min(1.0, 1.25 * (per + 8) / n)) for k, n in counts.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.lit(7), F.col("id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    # one row a language: a table of at most ``FEW`` languages is broadcast, a larger one is joined as Spark sees fit
    sample = rows.join(F.broadcast(rates) if len(counts) <= FEW else rates, "lang").where(draw < F.col("rate")).select("lang", "text")
    got = sample.mapInArrow(lean(_bits_pass(p)), "lang string, bits binary").distinct().collect()
    got = sorted((r["lang"], bytes(r["bits"])) for r in got)
    picked: dict[str, list[bytes]] = {}
    for lang, bits in sorted(got, key=lambda r: (r[0], zlib.crc32(r[1]), r[1])):
        if len(picked.setdefault(lang, [])) < per:
            picked[lang].append(bits)
    labels = [k for k, v in picked.items() for _ in v]
    if not labels:
        return none
    x = np.frombuffer(b"".join(b for v in picked.values() for b in v), np.uint8).reshape(len(labels), -(-p.dims // 8))
    del got, picked
    model = fit_kernel_ridge(x, labels, p, packed=True)
    give_back()
    return model


def _predict_pass(model: LanguageModel, at: int, extra: int):
    p = model.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for lo in range(0, batch.num_rows, p.batch):
                texts = batch.column(at).slice(lo, p.batch)
                x = np.zeros((len(texts), p.dims), np.float32)
                lettered = [presence(t.as_py(), p, row) for t, row in zip(texts, x, strict=True)]
                s = model.scores(x)
                for ok, row in zip(lettered, s, strict=True):
                    if not ok or len(row) == 0:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    k = int(row.argmax())
                    soft = np.exp((row - row[k]) / p.temperature)
                    # the share of the best score, lowered where even the best does not reach the class's target
                    pred.append(model.languages[k])
                    score.append(float(np.clip(1.0 / soft.sum() * np.clip((row[k] + 1) / 1.2, 0, 1), 0, 1)))
            names = batch.schema.names
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at or extra]
            kept = [n for i, n in enumerate(names) if i != at or extra]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); ``und`` and 0 for a null text or one without letters.

    Nothing but the text is looked at.  Every row is returned once, whatever its other columns hold; columns that are
    named like the two new ones are replaced by them.  An empty table gives an empty result.
    """
    docs = docs.drop(*({"lang_pred", "score"} - {text_col}))
    at = docs.columns.index(text_col)
    fields = [f for i, f in enumerate(docs.schema.fields) if keep_text or i != at]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(lean(_predict_pass(model, at, int(keep_text))), schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; such rows teach nothing.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
