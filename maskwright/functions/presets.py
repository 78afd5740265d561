"""Spans of the presets, found by Python's ``re``, the dialect that they were written in, over Arrow batches.

One pass of an automaton over a text finds where a match may begin for all patterns that begin with literals; they are tried
there only. The others go over the texts that Arrow's matcher or a literal leaves.

A small function inside the row: no shuffle, batch or stream. Java's matcher takes four times as long with Unicode
classes, and the plan of 95 patterns as Columns runs to thousands of expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import FIRST, HELD, PRESETS
from .spans import MARK, SPAN, SPARE

#: Texts, and about how many bytes of them, whose matches are held as Python values at once.
ROWS, BYTES = 8192, 1 << 22
#: Characters of all texts from which Arrow's matcher pays, which compiles its patterns at each call (some 4 ms).
WORTH = 1 << 14
#: Heads of a pattern at most.
HEADS = 256
_AROUND = re.compile(r"\(\?<?[!=](?:[^()\[\]\\]|\[[^\]]*\]|\\.)*\)")
_LEAD = re.compile(r"(\\b)?(\\d|\[(?:\\.|[^\]\\])+\])(?:\{(\d+)(,?)(\d*)\}|(\+))?")
_NAMES = ["entity_type", "start", "end", "score", "text", "seq", "source"]
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.string()]


def lead(pattern: str) -> str:
    """The same pattern with its first character apart, so that ``re`` looks for that before it tries to match."""
    found = _LEAD.match(pattern)
    if not found:
        return pattern
    border, one, least, comma, most, plus = found.groups()
    again = f"{one}*" if plus else f"{one}{{{int(least) - 1}{comma}{int(most) - 1 if most else ''}}}" if least else ""
    return one + (rf"(?<=\b{one})" if border else "") + again + pattern[found.end() :]


def re2(pattern: str) -> str:
    """A pattern in the dialect of Arrow's matcher that a text holds if it holds the pattern: without borders and lookarounds, its
    classes at least as wide."""
    wide = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": r"\s\x0b\x1c-\x1f\x{85}\p{Z}"}
    out, within, at = [], False, 0
    while at < len(pattern):
        one = pattern[at]
        if around := None if within else _AROUND.match(pattern, at):
            at = around.end()
            continue
        if one == "\\":
            name = pattern[at + 1]
            out.append(wide[name] if name in wide and within else f"[{wide[name]}]" if name in wide else "" if name == "b" else r"[\s\S]" if name == "S" and not within else pattern[at : at + 2])
            at += 2
            continue
        within = one == "[" or (within and one != "]")
        out.append("\\[" if one == "[" and pattern[at - 1 : at] == "[" else one)
        at += 1
    return "".join(out)


def _parts(pattern: str) -> list[str]:
    """What a pattern is joined from at its top level: groups, classes, escapes, quantifiers and single characters."""
    out, at = [], 0
    while at < len(pattern):
        size, depth, within = 0, 0, False
        while True:
            one = pattern[at + size]
            size += 2 if one == "\\" else 1
            within = one == "[" or (within and one != "]")
            depth += 0 if within else (one == "(") - (one == ")")
            if not depth and not within:
                break
        out.append(pattern[at : at + size])
        at += size
    return out


def _heads(pattern: str) -> tuple[set[str], bool]:
    """(what each match begins with, whether that is all of it)."""
    found, parts, at = {""}, _parts(pattern), 0
    if "|" in parts:
        k = parts.index("|")
        (a, x), (b, y) = _heads("".join(parts[:k])), _heads("".join(parts[k + 1 :]))
        return a | b, x and y
    while at < len(parts):
        part, at = parts[at], at + 1
        if part == "\\b" or _AROUND.fullmatch(part):
            continue
        if at < len(parts) and parts[at][0] in "?*+{":
            return found, False
        if part.startswith("(?:"):
            more, whole = _heads(part[3:-1])
        elif part[0] == "[" and not re.search(r"\^|\w-|[^\x00-\x7f]-|\\[a-zA-Z]", part):
            more, whole = {c[-1] for c in re.findall(r"\\?.", part[1:-1])}, True
        elif (part[0] == "\\" and not part[1].isalnum()) or (len(part) == 1 and part not in ".^$"):
            more, whole = {part[-1]}, True
        else:
            return found, False
        if len(found) * len(more) > HEADS:
            return found, False
        found = {a + b for a in found for b in more}
        if not whole:
            return found, False
    return found, True


def heads(pattern: str) -> frozenset[str]:
    """Literals of which each match begins with one, the shortest that tell; none if there are no good ones."""
    found = {h[:8] for h in _heads(pattern)[0]} if not pattern.startswith("(?i)") else {""}
    if any(not h or (len(h) == 1 and re.match(r"[\w.,:;=\-]", h, re.ASCII)) for h in found):
        return frozenset()
    return frozenset(h for h in found if not any(h != g and h.startswith(g) for g in found))


@dataclass(frozen=True)
class Scanners:
    """Presets by number: an automaton over the heads of those that have them, what is tried there, and for all others (preset,
    literals of which a text holds one, what Arrow looks for first, finder)."""

    automaton: object
    tried: dict[int, Callable]
    others: list[tuple[int, tuple[str, ...], str | None, Callable]]


@lru_cache(maxsize=16)
def _scanners(chosen: tuple[int, ...], ascii_only: bool) -> Scanners:
    import ahocorasick

    begin: dict[str, list[int]] = {}
    tried, others, flags = {}, [], re.ASCII if ascii_only else 0
    for k in chosen:
        _, _, pattern, literals = PRESETS[k]
        own = heads(pattern)
        for head in own:
            begin.setdefault(head, []).append(k)
        if own:
            tried[k] = re.compile(pattern, flags).match
        else:
            others.append((k, HELD.get(pattern, literals), re2(FIRST[pattern]) if pattern in FIRST else None, re.compile(lead(pattern), flags).finditer))
    automaton = ahocorasick.Automaton()
    for head, numbers in begin.items():
        automaton.add_word(head, (len(head) - 1, numbers))
    if begin:
        automaton.make_automaton()
    return Scanners(automaton, tried, others)


def _found(text: str, scanners: Scanners) -> list[tuple[int, int, int]]:
    """(preset, start, end) of each match in a text."""
    return _rows(pa.array([text]), [text], scanners)[0]


def _tried(text: str, scanners: Scanners) -> list[tuple[int, int, int]]:
    """The matches of the presets with heads: as ``finditer``, which could begin nowhere else."""
    starts: dict[int, list[int]] = {}
    for last, (back, numbers) in scanners.automaton.iter(text):
        for k in numbers:
            if k in starts:
                starts[k].append(last - back)
            else:
                starts[k] = [last - back]
    out = []
    for k, places in starts.items():
        if len(places) > 1:
            places.sort()
        match, end = scanners.tried[k], 0
        for start in places:
            if start >= end and (m := match(text, start)):
                end = m.end()
                out.append((k, start, end))
    return out


def _rows(texts: pa.Array, held: list[str | None], scanners: Scanners) -> list[list[tuple[int, int, int]]]:
    """(preset, start, end) of each match, for each text, in order; if there is text enough, Arrow's matcher says first which texts may hold
    a costly pattern."""
    rows = [_tried(t, scanners) if t else [] for t in held] if scanners.tried else [[] for _ in held]
    everywhere = [i for i, t in enumerate(held) if t]
    worth = sum(len(held[i]) for i in everywhere) >= WORTH
    for k, literals, first, finditer in scanners.others:
        if first is not None and worth:
            some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, first), False)).tolist()
        elif not literals:
            some = everywhere
        elif len(literals) == 1:
            some = [i for i in everywhere if literals[0] in held[i]]
        else:
            some = [i for i in everywhere if any(map(held[i].__contains__, literals))]
        for i in some:
            for m in finditer(held[i]):
                start, end = m.span()
                if end > start:
                    rows[i].append((k, start, end))
    for row in rows:
        row.sort()
    return rows


def _resolved(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """As ``spans.resolve_overlaps``, of spans of one score."""
    out, start, end = [], -1, -1
    for x in sorted(found, key=lambda x: (x[1], -x[2])):
        if end >= x[2] and (start < x[1] or end > x[2]):
            continue
        out.append(x)
        if x[2] > end:
            _, start, end = x
    return out


@dataclass(frozen=True)
class Chosen:
    """The spans that filters leave, which are numbered then: of these presets, without these surfaces; with ``again`` overlaps are
    resolved once more behind the filters."""

    presets: frozenset[int]
    blocked: frozenset[str]
    again: bool = False


def _spans(texts: pa.Array, scanners: Scanners, resolve: bool, only: Chosen | None) -> pa.Array:
    held = texts.to_pylist()
    rows = _rows(texts, held, scanners)
    if resolve:
        rows = [_resolved(x) if len(x) > 1 else x for x in rows]
    if only:
        rows = [[x for x in row if x[0] in only.presets and t[x[1] : x[2]] not in only.blocked] if row else row for t, row in zip(held, rows)]
        if only.again:
            rows = [_resolved(x) if len(x) > 1 else x for x in rows]
    k, start, end = (pa.array([x[i] for row in rows for x in row], pa.int32()) for i in range(3))
    text = pa.array([t[s:e] for t, row in zip(held, rows) for _, s, e in row], pa.string())
    n = len(k)
    label = pa.array([p[1] for p in PRESETS]).take(k)
    columns = [label, start, end, pa.repeat(pa.scalar(1.0), n), text, pa.array([i for row in rows for i in range(len(row))], pa.int32()) if only else pa.repeat(pa.scalar(0, pa.int32()), n), pa.repeat(pa.scalar("regex"), n)]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.StructArray.from_arrays(columns, names=_NAMES))


def finder(chosen: list[int], dialect: str, resolve: bool, only: Chosen | None = None) -> Callable[[pa.Array], pa.Array]:
    """The spans of presets, by number, of each text of an array; null text has none."""

    def run(texts: pa.Array) -> pa.Array:
        scanners = _scanners(tuple(chosen), dialect != "gateway")
        step = max(1, min(ROWS, BYTES * len(texts) // max(1, texts.nbytes)))
        return pa.concat_arrays([_spans(texts.slice(at, step), scanners, resolve, only) for at in range(0, max(1, len(texts)), step)])

    return run


def rows_of(dialect: str) -> Callable[[str | None], list[tuple[str, int, int, str]]]:
    """(entity type, start, end, text) of the resolved spans of all presets of one text."""
    scanners = _scanners(tuple(range(len(PRESETS))), dialect != "gateway")
    safe = str.maketrans(MARK, SPARE)
    return lambda text: [(PRESETS[k][1], s, e, t[s:e]) for t in [text.translate(safe) if MARK in text else text] for k, s, e in _resolved(_found(t, scanners))] if text else []


def spans(text: Column, chosen: list[int], dialect: str, resolve: bool = False, only: Chosen | None = None) -> Column:
    """array<span> of a text; ``text`` must be ``safe``. With ``resolve`` overlaps are resolved, with ``only`` spans filtered then."""
    return function(chosen, dialect, resolve, only)(text)


def function(chosen: list[int], dialect: str, resolve: bool = False, only: Chosen | None = None):
    """``spans`` as a function that can be registered for SQL."""
    return function_of(finder(chosen, dialect, resolve, only))


def function_of(find: Callable[[pa.Array], pa.Array]):
    def run(texts: pa.Array) -> pa.Array:
        return find(texts)

    return F.arrow_udf(run, f"array<{SPAN}>")


def spans_of_each(texts: Column, chosen: list[int], dialect: str, resolve: bool = False) -> Column:
    """array<array<span>> of an array of texts."""
    find = finder(chosen, dialect, resolve)

    def run(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), find(lists.flatten()))

    return F.arrow_udf(run, f"array<array<{SPAN}>>")(texts)


def matches(text: Column, entity_type: str, pattern: str, source: str = "regex") -> Column:
    """array<span> of all non-empty matches of a pattern in the dialect of ``re``; null text has none. ``text`` must be ``safe``."""

    def run(texts: pa.Array) -> pa.Array:
        held, finditer = texts.to_pylist(), re.compile(pattern).finditer
        rows = [[(*m.span(), m.group()) for m in finditer(t) if m.end() > m.start()] if t else [] for t in held]
        start, end, found = (pa.array([x[i] for row in rows for x in row], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string())))
        fixed = [pa.repeat(pa.scalar(v, kind), len(start)) for v, kind in ((entity_type, pa.string()), (1.0, pa.float64()), (0, pa.int32()), (source, pa.string()))]
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.StructArray.from_arrays([fixed[0], start, end, fixed[1], found, fixed[2], fixed[3]], names=_NAMES))

    return F.arrow_udf(run, f"array<{SPAN}>")(text)


def joined(arrays: list[Column], always: bool) -> Column:
    """The spans of arrays of the row, which must not be null, in turn, overlaps resolved as by ``spans.resolve_overlaps``: with ``always`` where the last array
    holds one, else where two arrays do.

    Not for use within a lambda. Spans need their offsets; those without stay, ahead of all others.
    """

    def run(*lists: pa.Array) -> pa.Array:
        sizes = np.array([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists])
        n = sizes.shape[1]
        row = np.concatenate([np.repeat(np.arange(n), k) for k in sizes])
        # detectors may differ in which fields can be null, and Arrow takes these for other types
        spans = pa.concat_arrays([pa.StructArray.from_arrays([c.cast(k) for c, k in zip(x.flatten().flatten(), _KINDS)], names=_NAMES) for x in lists])
        resolve = sizes[-1] > 0 if always else (sizes > 0).sum(axis=0) > 1
        start, end, score = (spans.field(name) for name in ("start", "end", "score"))
        bare = pc.or_(pc.is_null(start), pc.is_null(end)).to_numpy(zero_copy_only=False)
        start, end = (pc.fill_null(x, -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (start, end))
        # a missing score is unknown, one that is no number is above all
        known = pc.fill_null(score, 0.0).to_numpy(zero_copy_only=False)
        score = np.where(pc.is_null(score).to_numpy(zero_copy_only=False), np.nan, np.where(np.isnan(known), np.inf, known))
        again = resolve[row]
        order = np.lexsort((np.where(again, -end, 0), np.where(again, start, 0), ~bare & again, row))
        kept: list[int] = []
        last, s0, e0, c0 = -1, -1, -1, -1.0
        for i, r, s, e, c, look in zip(order.tolist(), row[order].tolist(), start[order].tolist(), end[order].tolist(), score[order].tolist(), (again & ~bare)[order].tolist()):
            if look:
                if r != last:
                    last, s0, e0, c0 = r, -1, -1, -1.0
                if e0 >= e and not c0 < c and (s0 < s or e0 > e):
                    continue
                if e > e0 or (e == e0 and c > c0):
                    s0, e0, c0 = s, e, c
            kept.append(i)
        sums = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=n))]) if kept else np.zeros(n + 1)
        return pa.ListArray.from_arrays(pa.array(sums, pa.int32()), spans.take(pa.array(kept, pa.int64())))

    return F.arrow_udf(run, f"array<{SPAN}>")(*arrays)
