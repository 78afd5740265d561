"""Toxicity: a character n-gram linear classifier scaled by naive Bayes log-count ratios.

Texts are lower-cased and everything but letters and digits becomes a space, so that n-grams see word borders.
The n-grams (of UTF-8 bytes, hashed into ``BUCKETS``) of a text give one feature if present and one more for each
further count that they reach (``LEVELS``): where the marks of toxic text are word parts that clean text holds now and
then, only their return tells. Levels and rounds were chosen by three folds within the training rows. The features of the training rows are counted by class on Spark; the ``VOCABULARY``
features with the highest chi-square stay, each with its log-count ratio, and a logistic regression is fitted on
feature times ratio. Training uses at most ``max_rows`` labelled rows, a bound that
does not grow with the input; scoring goes over every whole text.

Defined results: null and empty texts have no n-gram and get the score of the intercept; equal texts get equal
scores; without labelled rows of both classes every score is the share of label 1 (0 without any row).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, labelled_ids, take

MAX_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SIZES = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
LEVELS = (1, 2, 3)
VOCABULARY = 4096
_BORDER = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PART = 1 << 18


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole text, in slices of bounded size that overlap by the longest n-gram."""
    raw = b" " + (text or "").lower().encode().translate(_BORDER) + b" "
    if len(raw) < 3 or raw.isspace():
        return
    data = np.frombuffer(raw, np.uint8)
    for start in range(0, len(data), _PART):
        part = data[start : start + _PART + max(SIZES) - 1].astype(np.uint32)
        code, n = part, 1
        for size in SIZES:
            while n < size and len(code) > 1:
                code = code[:-1] * np.uint32(0x01000193) + part[n:]
                n += 1
            if n == size:
                yield ((code[:_PART] + np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def features(found: list[np.ndarray]) -> np.ndarray:
    """Features of n-gram occurrences: the bucket, moved by ``BUCKETS`` for each further level that its count reaches."""
    bucket, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32),) * 2
    return np.concatenate([bucket[count >= least].astype(np.int64) + k * BUCKETS for k, least in enumerate(LEVELS)])


@dataclass
class Linear:
    slot: np.ndarray  # by feature: position in the vocabulary plus one, or zero
    used: np.ndarray  # by bucket: whether any of its features is in the vocabulary
    weight: np.ndarray  # by position, after one leading zero: ratio times coefficient
    intercept: float

    def present(self, text: str | None) -> np.ndarray:
        hits = self.slot[features([h[self.used[h]] for h in buckets(text)])]
        return hits[hits > 0]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[self.present(text)].sum() + self.intercept, -30, 30))))


def _regression(hits: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features and the intercept, by accelerated gradient descent."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.concatenate([*hits, np.zeros(0, np.int64)]).astype(np.int64)
    value = ratio[col]
    w, share = np.zeros(len(ratio)), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    wide = np.bincount(row, value**2, len(y))
    step = 4.0 / (1 + np.sqrt((wide**2).mean()))
    vw, vb = np.zeros_like(w), 0.0
    for k in range(rounds):
        m = k / (k + 3)
        aw, ab = w + m * vw, b + m * vb
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * aw[col], len(y)) + ab, -30, 30)))
        err = (p - y) / len(y)
        nw = aw - step * (np.bincount(col, value * err[row], len(ratio)) + ridge * aw)
        nb = ab - step * err.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Linear:
    """Fits on labelled rows outside the held-out fold, at most ``max_rows``.

    The driver gets sums for at most ``VOCABULARY`` features, then their positions in at most ``max_rows`` texts.
    """
    ids = labelled_ids(labels, label_col, crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT, max_rows)
    rows = cut(take(docs, id="doc_id", text="text").join(F.broadcast(ids), "id").select("label", "text").repartition(8))  # bounded by max_rows

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(LEVELS) * BUCKETS), np.int32)
        for b in parts:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[int(label == 1), features(list(buckets(text)))] += 1
        found = np.flatnonzero(sums.any(axis=0))
        for k in range(0, len(found), 1 << 16):
            f = found[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(sums[1, f]), pa.array(sums[0, f])], names=["feature", "pos", "neg"])

    total = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") == 1).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Linear(np.zeros(len(LEVELS) * BUCKETS, np.int16), np.zeros(BUCKETS, bool), np.zeros(1), float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / (1 - np.clip(share, 1e-9, 1 - 1e-9)))))
    sums = rows.mapInArrow(count, "feature int, pos int, neg int").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = sums.where(F.col("pos") + F.col("neg") >= 3)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    chi = (pos * (F.lit(n0) - neg) - neg * (F.lit(n1) - pos)) ** 2 / ((pos + neg) * (F.lit(n1 + n0) - pos - neg) + 1)
    top = sums.orderBy(chi.desc(), "feature").limit(VOCABULARY).toPandas().sort_values("feature")
    p, q = top["pos"].to_numpy(float) + 1, top["neg"].to_numpy(float) + 1
    ratio = np.concatenate([[0.0], np.log(p / (n1 + 2)) - np.log(q / (n0 + 2))])
    chosen = top["feature"].to_numpy(np.int64)
    model = Linear(np.zeros(len(LEVELS) * BUCKETS, np.int16), np.zeros(BUCKETS, bool), np.zeros(len(ratio)), 0.0)
    model.slot[chosen] = np.arange(1, len(ratio))
    model.used[chosen % BUCKETS] = True
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.present(t.as_py()).astype(np.int16).tobytes() for t in b.column(1)], pa.binary())], names=["label", "hits"])

    found = rows.mapInArrow(mark, "label int, hits binary").toPandas().sort_values(["hits", "label"])
    w, b = _regression([np.frombuffer(h, np.int16) for h in found["hits"]], (found["label"] == 1).to_numpy(float), ratio)
    return Linear(model.slot, model.used, ratio * w, b)


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["id", "score"])

    rows = take(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    rows = score(docs, train(docs, labels, max_rows=max_rows))
    return rows.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents whose score stays below the threshold; columns as given."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows=max_rows))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield b.filter(pa.array([model.value.score(t.as_py()) < THRESHOLD for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
