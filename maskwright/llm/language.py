"""Language identification by a convolutional network over bytes.

A byte embedding, filters of several widths, max pooling over a window and a softmax, trained here in numpy on
windows of labelled texts. Prediction cuts each whole text into windows of one length, runs them in batches and
adds up the windows' log-probabilities, weighted by their bytes.

Trained on all windows of at most ``PER_LANGUAGE`` texts for each label, which does not grow with the number of
texts. Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was
learned; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, take

FOLDS, HELD_OUT = 5, 0
PER_LANGUAGE = 300
LENGTH = 256
WIDTHS = (2, 3, 4)
BATCH = 64


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width * dim, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Pooled activations of windows (n, LENGTH), the positions of the maxima and the patches there."""
        e = self.embed[x]
        n, length, dim = e.shape
        tops, places, patches = [], [], []
        for width, w, b in zip(WIDTHS, self.filters, self.bias):
            view = np.lib.stride_tricks.as_strided(e, (n, length - width + 1, width * dim), e.strides)
            conv = (np.ascontiguousarray(view).reshape(-1, width * dim) @ w).reshape(n, length - width + 1, -1)
            place = conv.argmax(axis=1)
            tops.append(np.maximum(np.take_along_axis(conv, place[:, None, :], axis=1)[:, 0] + b, 0))
            places.append(place)
            patches.append(view)
        return np.concatenate(tops, axis=1), places, patches

    def maxima(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        n, length, dim = e.shape
        tops = []
        for width, w, b in zip(WIDTHS, self.filters, self.bias):
            view = np.lib.stride_tricks.as_strided(e, (n, length - width + 1, width * dim), e.strides)
            conv = (np.ascontiguousarray(view).reshape(-1, width * dim) @ w).reshape(n, length - width + 1, -1)
            tops.append(np.maximum(conv.max(axis=1) + b, 0))
        return np.concatenate(tops, axis=1)

    def logs(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, LENGTH) bytes of the whole lower-cased text, the last window padded with zeros; bytes in each."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(raw) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(raw)] = raw
    size = np.full(n, LENGTH, np.int64)
    size[-1] = len(raw) - (n - 1) * LENGTH
    return out.reshape(n, LENGTH), size


def gradients(net: Network, xb: np.ndarray, yb: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, by parameter; the max pooling passes them only to the winning patches."""
    rows, filters = np.arange(len(xb)), net.filters[0].shape[1]
    pooled, places, patches = net.pooled(xb)
    d = np.exp(net.logs(pooled))
    d[rows, yb] -= 1
    d /= len(xb)
    back = (d @ net.out.T) * (pooled > 0)
    g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
    for j, (width, w) in enumerate(zip(WIDTHS, net.filters)):
        part = back[:, j * filters : (j + 1) * filters]
        won = patches[j][rows[:, None], places[j]]  # (rows, filters, width * dim)
        g_filters.append(np.einsum("nf,nfd->df", part, won))
        g_bias.append(part.sum(axis=0))
        pieces = (part[:, :, None] * w.T[None]).reshape(len(xb), filters, width, -1)
        at = xb[rows[:, None, None], places[j][:, :, None] + np.arange(width)]
        np.add.at(g_embed, at.ravel(), pieces.reshape(-1, pieces.shape[-1]))
    return [g_embed, *g_filters, *g_bias, pooled.T @ d, d.sum(axis=0)]


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], dim: int = 8, filters: int = 12, epochs: int = 4, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages, rng.normal(0, 0.5, (256, dim)).astype(np.float32), [rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters)).astype(np.float32) for w in WIDTHS],
        [np.zeros(filters, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            rows = order[k : k + BATCH]
            t += 1
            for p, g, a, b in zip(params, gradients(net, x[rows], y[rows]), m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Fits on texts with a label outside the held-out fold: at most ``per_language`` texts for each label.

    The texts are picked by hash of the id, one for each of ``per_language`` slots, which needs no large group.
    """
    rows = take(docs, id="doc_id", text="text", lang="lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("id"), FOLDS) != HELD_OUT))
    hashed = rows.select("id", "lang", F.xxhash64("id").alias("h"))
    picked = hashed.groupBy("lang", F.pmod("h", F.lit(per_language)).alias("slot")).agg(F.min_by("id", F.struct("h", "id")).alias("id")).select("id", F.col("lang").alias("label"))
    texts = rows.join(F.broadcast(picked), "id").where(F.col("lang") == F.col("label")).select("label", "text")  # bounded by per_language

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            labels, found = [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not any(map(str.isalpha, text)):
                    continue
                x, _ = windows(text)
                labels += [label] * len(x)
                found += [w.tobytes() for w in x]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(found, pa.binary())], names=["label", "bytes"])

    found = texts.mapInArrow(run, "label string, bytes binary").toPandas().sort_values(["label", "bytes"])
    if not len(found):
        return None
    languages = sorted(set(found["label"]))
    x = np.frombuffer(b"".join(found["bytes"]), np.uint8).reshape(-1, LENGTH)
    y = np.searchsorted(np.array(languages, object), found["label"].to_numpy(object))
    return fit(x, y, languages)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def judge(texts: list[str]) -> list[tuple[str, float]]:
        net = shared.value
        cut = [windows(t) for t in texts]
        x, sizes = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
        logs = np.concatenate([net.logs(net.maxima(x[k : k + BATCH])) for k in range(0, len(x), BATCH)])
        starts = np.cumsum([0, *[len(c[0]) for c in cut]])[:-1]
        mean = np.add.reduceat(logs * sizes[:, None], starts) / np.add.reduceat(sizes, starts)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [(net.languages[k], float(q[k])) for q, k in zip(p, p.argmax(axis=1))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                texts = s.column(1).to_pylist()
                known = [k for k, t in enumerate(texts) if shared.value is not None and t and any(map(str.isalpha, t))]
                found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
                if known:
                    for k, r in zip(known, judge([texts[k] for k in known])):
                        found[k] = r
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["id", "lang_pred", "score"])

    rows = take(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def judged(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    return predict(docs, train(docs, per_language)).select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
