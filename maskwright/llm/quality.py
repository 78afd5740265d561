"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features with the logistic loss, and kept as arrays of one shape
(tree, node), so that scoring walks all rows of a batch through a level of a tree with three numpy look-ups.
Fitted on at most ``max_rows`` labelled rows (a bound that does not grow with the input); every document is
scored in whole.

Defined results: null and empty texts get the statistics of an empty text and so a score like any other; equal
texts get equal scores; a table without labels for the training folds gives the score 0.5 everywhere.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_ids, take

MAX_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\f\v", "line": b"\n",
    "stop": b".!?", "pause": b",;:", "loud": b"!", "symbol": b"#$%&*@^~=+<>\\/_", "bar": b"|", "bracket": b"()[]{}", "quote": b"\"'`", "dash": b"-",
    "wide": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members), _k] = 1
FEATURES = [*(f"{c}_share" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_words", "distinct_pairs", "line_words", "distinct_lines", "top_word", "ends"]


def features(text: str | None) -> list[float]:
    """Statistics of a whole text."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / n
    words = raw.lower().split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    distinct = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(operator.eq, words, words[1:]))
    top = max(distinct.values(), default=0)
    ends = sum(x.endswith((b".", b"!", b"?", b'"')) for x in lines)
    more = [np.log1p(len(raw)), np.log1p(len(words)), len(raw) / m, len(distinct) / m, same / m, pairs / m, len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), top / m, ends / max(1, len(lines))]
    return [*shares, *more]


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))


class Boosted:
    """Flattened trees: ``feature`` and ``cut`` by (tree, inner node), ``leaf`` by (tree, leaf)."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.cut, self.leaf = (np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 3.0) -> Boosted:
    """Boosting with the logistic loss on at most ``bins`` quantile bins of each feature."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    if len(set(y.tolist())) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    width, inner = bins, 2**depth - 1
    flat = binned + np.arange(x.shape[1]) * width
    raw = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            size = x.shape[1] * width
            slot = ((node - first)[:, None] * size + flat).ravel()
            g = np.bincount(slot, np.repeat(grad, x.shape[1]), count * size).reshape(count, x.shape[1], width).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(hess, x.shape[1]), count * size).reshape(count, x.shape[1], width).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            for k in range(count):
                f, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + ridge)
        raw += leaf[at]
        model.feature, model.cut, model.leaf = (np.concatenate([a, b[None]]) for a, b in ((model.feature, feature), (model.cut, cut), (model.leaf, leaf)))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Boosted:
    """Fits on labelled rows outside the held-out fold, at most ``max_rows``; only their statistics reach the driver."""
    ids = labelled_ids(labels, label_col, crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT, max_rows)
    rows = take(docs, id="doc_id", text="text").join(F.broadcast(ids), "id").select("label", "text")  # bounded by max_rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=["label", *FEATURES])

    found = rows.mapInArrow(run, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    found = found.sort_values(list(found.columns))  # the same model whatever the order of the rows
    return fit(found[FEATURES].to_numpy(), found["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_matrix(b.column(1))))], names=["id", "score"])

    rows = take(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    rows = score(docs, train(docs, labels, max_rows=max_rows))
    return rows.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents whose score reaches the threshold; columns as given."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows=max_rows))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield b.filter(pa.array(model.value.score(_matrix(b.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
