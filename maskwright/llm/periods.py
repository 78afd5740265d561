"""Periodic runs of words: stretches that repeat a block of q words again and again.

A run is a stretch of words with smallest period q (words q apart are identical) of at least ``max(24, 3 * q)`` words
that no neighbouring word extends keeping the period. Every run holds a Lyndon word of length q under one of two orders of
the words, one the reverse of the other, and that word is the longest Lyndon word at its place. So:

* ``lyndon`` is phase one of Baier's suffix sorting: suffixes in groups by the Lyndon word they are known to begin with,
  the highest group first; each group lengthens the word of the next suffix to its left that lies in a lower group.
  A group's word is final when it is reached, so its length is the Lyndon array, once for each order.
* ``runs_of`` takes Lyndon words that follow themselves as roots and extends them to both sides by the longest common
  extension (``lce``) of the words one period apart.

Before that, words that can't lie in a run are left out (``_stretches``). Each window of 8 words in a run comes again within
the run, one period on or back, as a run has at least 24 words and three periods. Windows are compared by hash; a collision
keeps words that need not be kept and loses none. What is left is stretches of windows that recur in their text.

One pass over the rows, no shuffle; a task holds one slice of a batch at a time. Null words count as one word, equal to
itself. A row whose words are null or empty has no runs and an empty collapsed text. Texts of any length are read whole;
repeated rows and rows without an id are handled each by itself; other columns stay as they are, and the names
``runs`` and ``collapsed`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words of a run at least, and periods.
LEAST, TIMES = 24, 3
#: Words of a window: each window of up to 9 in a run recurs in it, as 2 q + 9 - 1 <= max(24, 3 q).
WINDOW = 8
#: Words that are looked at together.
SLICE = 500_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def lyndon(words: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, for words that are numbers from 0."""
    n = len(words)
    length_at = [0] * n
    top = max(words) + 1 if n else 0
    members: list[list[int]] = [[] for _ in range(top)]
    for i, w in enumerate(words):
        members[w].append(i)
    group = list(words)
    size = [1] * top
    lower, upper = list(range(-1, top - 1)), [*range(1, top), -1]
    before = list(range(n))  # place i: the next place at or left of i - 1 that no group has reached, plus one; by halving
    reached = bytearray(n)
    g = top - 1
    while g >= 0:
        here, long = [i for i in members[g] if group[i] == g], size[g]
        for i in here:
            reached[i] = 1
            length_at[i] = long
        times: dict[int, int] = {}
        for i in here:
            j = before[i]
            while j and reached[j - 1]:
                j = before[i] = before[j - 1]
            if j:
                times[j - 1] = times.get(j - 1, 0) + 1
        if times:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                moved.setdefault((-k, group[j]), []).append(j)
            for (k, old), places in sorted(moved.items()):
                new = len(size)
                size.append(size[old] - k * long)
                members.append(places)
                lower.append(old)
                upper.append(upper[old])
                if upper[old] >= 0:
                    lower[upper[old]] = new
                upper[old] = new
                for j in places:
                    group[j] = new
        members[g] = []
        g = lower[g]
    return length_at


def lce(words: np.ndarray, a: int, b: int, step: int = 1) -> int:
    """How many words from places a and b on (or back, with step -1) are the same, for a < b; by blocks that double."""
    done, block = 0, 32
    most = len(words) - b if step > 0 else a + 1
    while done < most:
        block = min(block, most - done)
        if step > 0:
            differ = words[a + done : a + done + block] != words[b + done : b + done + block]
        else:
            differ = words[a - done - block + 1 : a - done + 1][::-1] != words[b - done - block + 1 : b - done + 1][::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += block
        block *= 2
    return done


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. A run of three periods holds its root twice in a row."""
    n = len(words)
    _, ranks = np.unique(words, return_inverse=True)
    found: set[tuple[int, int, int]] = set()
    for order in (ranks, ranks.max() - ranks) if n else ():
        root = np.array(lyndon(order.tolist()), np.int64)
        i = np.flatnonzero(np.arange(n) + root < n)
        i = i[(root[i + root[i]] == root[i]) & (words[i] == words[i + root[i]])]
        until: dict[int, int] = {}  # by period: the end of the last run found
        for at, q in zip(i.tolist(), root[i].tolist()):
            if at + q <= until.get(q, -1):
                continue
            left = lce(words, at - 1, at + q - 1, -1) if at else 0
            right = lce(words, at, at + q)
            length = left + q + right
            if length >= TIMES * q:
                until[q] = at + q + right
                if length >= LEAST:
                    found.add((at - left, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _again(codes: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which words lie in a window that its part holds twice."""
    n = len(codes)
    covered = np.zeros(n + 1, np.int64)
    if n < WINDOW:
        return covered[:n] > 0
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in (1, 2, 4):  # windows of 2, 4 and 8 words
        h = h[:-k] * np.uint64(0xBF58476D1CE4E5B9) + h[k:]
        h ^= h >> np.uint64(31)
    whole = np.flatnonzero(part[: n - WINDOW + 1] == part[WINDOW - 1 :])
    h = h[whole] * np.uint64(0x94D049BB133111EB) + part[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = whole[twice]
    np.add.at(covered, starts, 1)
    np.subtract.at(covered, starts + WINDOW, 1)
    return np.cumsum(covered[:n]) > 0


def _stretches(codes: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) of the stretches that may hold runs."""
    at, part = np.arange(len(codes)), row.astype(np.int64)
    while True:
        kept = at[_again(codes[at], part)] if len(at) else at
        cut = np.flatnonzero((np.diff(kept) != 1) | (row[kept[1:]] != row[kept[:-1]])) + 1
        bounds = np.concatenate([[0], cut, [len(kept)]]) if len(kept) else np.zeros(1, np.int64)
        sizes = np.diff(bounds)
        long = np.repeat(sizes >= LEAST, sizes)
        done = len(kept) > 0.9 * len(at)  # a further round would leave out little
        at, part = kept[long], np.repeat(np.arange(len(sizes)), sizes)[long]
        if done or not len(at):
            return [(int(kept[a]), int(kept[b - 1]) + 1) for a, b in zip(bounds[:-1], bounds[1:]) if b - a >= LEAST] if len(kept) else []


def _slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows in slices of about ``SLICE`` words."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(lists):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        yield lists.slice(first, last - first)
        first = last


def _solved(lists: pa.ListArray) -> tuple[list[list[dict]], pa.Array]:
    """The runs of each row and its words without the repeats, joined by spaces."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = lists.flatten()
    codes = flat.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    runs: list[list[dict]] = [[] for _ in range(len(lists))]
    gone = np.zeros(len(codes) + 1, np.int64)
    for a, b in _stretches(codes, row):
        for start, length, q in runs_of(codes[a:b]):
            runs[row[a]].append({"start": int(a + start - starts[row[a]]), "length": length, "period": q})
            gone[a + start + q] += 1
            gone[a + start + length] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(stay)])[starts].astype(np.int32)
    left = flat.filter(pa.array(stay)) if len(flat) else flat.cast(pa.string())
    return [sorted(r, key=lambda x: (x["start"], x["period"])) for r in runs], pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.fill_null(left, "")), " ")


def with_runs(df: DataFrame, words_col: str = "words") -> DataFrame:
    """``df`` with ``runs``, array<struct<start, length, period>> by start, then period, and ``collapsed``: the words joined by
    spaces, without those that a run holds behind its first period."""
    rest = df.drop("runs", "collapsed")
    at = rest.columns.index(words_col)
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            lists = b.column(at).cast(pa.list_(pa.string()))
            first = 0
            for piece in _slices(lists):
                runs, text = _solved(piece)
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(piece)).columns, pa.array(runs, kind), text.cast(pa.string())], names=[*b.schema.names, "runs", "collapsed"])
                first += len(piece)

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]))
