"""Span arrays as Columns: finding, ordering, resolving, numbering. Nothing here shuffles, so all of it runs on streams.

A span is a struct (entity_type, start, end, score, text, seq, source); offsets count code points from 0 and ends
are exclusive. Matches are found by wrapping every match in a mark, splitting at the marks and summing lengths:
every second piece is a match. A noncharacter serves as mark; one that occurs in a text is swapped for another
one first, so lengths stay right.

A text may hold many thousands of spans, so nothing here compares spans pairwise or copies what it has so far for each
span: running values are carried over slices of an array (``scanned``), equal keys are brought together by sorting, and
parts of a text are cut from blocks of it (``blocks``, ``between``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import alternation, java

MARK, SPARE = "﷐", "﷒"
SPAN = "struct<entity_type:string,start:int,end:int,score:double,text:string,seq:int,source:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(entity_type: Column, start: Column, end: Column, score: Column, text: Column, source: str = "regex") -> Column:
    return F.struct(entity_type.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"), text.alias("text"), F.lit(0).alias("seq"), F.lit(source).alias("source"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def unfolded(df: DataFrame, array: Column | str, *keep: str, place: str | None = None) -> DataFrame:
    """``keep`` and the fields of each struct of an array, with its place if named.

    The outer generator with a filter behind it: before an inner one Spark would put a filter on the array's
    size, and so work the whole array out again.
    """
    item = F.posexplode_outer(array).alias(place or "__place", "__item")
    out = df.select(*keep, item).where(F.col("__item").isNotNull())
    return out.select(*keep, *([place] if place else []), "__item.*")


SLICE = 64
BLOCK = 2048


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], give: Callable[[Column, Column], Column]) -> Column:
    """``give(carry, item)`` for each item of an array, the carry going on with ``step(carry, item)``.

    Slice by slice: first the carry at the start of each, then the results within each, so that growing arrays are
    copied within slices only.
    """

    def of(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / SLICE).cast("int"), F.lit(0)))
        part = lambda k: F.slice(x, k * SLICE + 1, SLICE)
        carries = F.aggregate(numbers, F.array(zero), lambda acc, k: F.concat(acc, F.array(F.aggregate(part(k), F.element_at(acc, -1), step))))
        return let(carries, lambda c: F.flatten(F.transform(numbers, lambda k: within(part(k), c[k]))))

    def within(s: Column, carry: Column) -> Column:
        first = F.struct(carry.alias("carry"), F.array_compact(F.array(F.when(F.lit(False), give(carry, s[0])))).alias("out"))
        grown = lambda acc, x: F.struct(step(acc["carry"], x).alias("carry"), F.concat(acc["out"], F.array(give(acc["carry"], x))).alias("out"))
        return F.aggregate(s, first, grown, lambda acc: acc["out"])

    return let(items, of)


def blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` characters, for ``between``."""
    return let(text, lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / BLOCK).cast("int")), lambda k: F.substr(t, k * BLOCK + 1, F.lit(BLOCK))))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end`` of a text in blocks; empty if there are none."""

    def part(a: Column, b: Column) -> Column:
        one = lambda k: F.substr(cut[k], F.greatest(a - k * BLOCK, F.lit(0)) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0)))
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        return F.when(b <= a, "").when(first == last, one(first)).otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), one), ""))

    return part(F.greatest(start, F.lit(0)), F.least(end, (F.size(cut) - 1) * BLOCK + F.length(F.element_at(cut, -1))))


def safe(text: Column) -> Column:
    return F.when(text.contains(MARK), F.translate(text, MARK, SPARE)).otherwise(text)


def _matches(pieces: Column, entity_type: Column, source: str, score: float = 1.0) -> Column:

    def found(p: Column) -> Column:
        starts = scanned(p, F.lit(0), lambda at, x: at + F.length(x), lambda at, x: at)
        one = lambda at: F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: span(entity_type, at[i], at[i] + F.length(p[i]), F.lit(score), p[i], source))
        return F.when(F.size(p) > 1, F.filter(let(starts, one), lambda s: s["end"] > s["start"])).otherwise(none())

    return F.coalesce(let(pieces, found), none())


def _pieces(text: Column, pattern: str, dialect: str) -> Column:
    return F.split(F.regexp_replace(text, java(pattern, dialect), f"{MARK}$0{MARK}"), MARK, -1)


def regex_spans(text: Column, entity_type: str, pattern: str, dialect: str = "gateway", source: str = "regex", score: float = 1.0) -> Column:
    """All non-overlapping non-empty matches from left to right; null text has none. ``text`` must be ``safe``."""
    return _matches(_pieces(text, pattern, dialect), F.lit(entity_type), source, score)


def patterns_spans(text: Column, patterns: list[tuple[str, str, Callable[[Column], Column] | None]], dialect: str = "gateway", source: str = "regex", traits: dict[str, str] | None = None) -> Column:
    """Spans of many (entity type, pattern, gate) in order; a pattern runs only where its gate holds.

    A gate takes a struct of the text, as ``t``, and of whether it holds each of the named ``traits``, looked for once.
    """
    if not patterns:
        return none()

    def found(x: Column) -> Column:
        t = x["t"]
        hits = [F.struct(F.lit(label).alias("label"), (_pieces(t, p, dialect) if gate is None else F.when(gate(x), _pieces(t, p, dialect))).alias("pieces")) for label, p, gate in patterns]
        some = F.filter(F.array(*hits), lambda h: F.coalesce(F.size(h["pieces"]) > 1, F.lit(False)))
        return F.flatten(F.transform(some, lambda h: _matches(h["pieces"], h["label"], source)))

    return let(F.struct(text.alias("t"), *[text.rlike("(?U)" + p).alias(name) for name, p in (traits or {}).items()]), found)


def dictionary_spans(text: Column, entity_type: str, words: list[str], ascii_boundary: bool = False, dialect: str = "gateway") -> Column:
    return regex_spans(text, entity_type, alternation(words, ascii_boundary), dialect)


def literal_spans(text: Column, value: Column, entity_type: Column, source: str = "literal") -> Column:
    """Occurrences of a literal from left to right, each search going on behind the last match."""
    return F.when(F.coalesce(F.length(value) > 0, F.lit(False)), _matches(F.split(F.replace(text, value, F.concat(F.lit(MARK), value, F.lit(MARK))), MARK, -1), entity_type, source)).otherwise(none())


def numbered(spans: Column) -> Column:
    """``seq`` set to the place in the array: the order of arrival."""
    return F.transform(spans, lambda s, i: F.struct(*[s[n].alias(n) for n in ("entity_type", "start", "end", "score", "text")], i.alias("seq"), s["source"].alias("source")))


def by_position(spans: Column, key: Callable[[Column, Column], Column]) -> Column:
    """The spans ordered by a key of (span, place)."""
    return F.transform(F.sort_array(F.transform(spans, lambda s, i: F.struct(key(s, i).alias("k"), s.alias("s")))), lambda x: x["s"])


def valid_spans(spans: Column, text: Column) -> Column:
    """Spans with offsets in range and end > start."""
    return F.filter(spans, lambda s: F.coalesce((s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)), F.lit(False)))


def resolve_overlaps(spans: Column) -> Column:
    """Ordered by (start, end descending, arrival), drops what lies within an earlier span of at least its score.

    A running envelope (the span reaching furthest, of these the best score) stands for all earlier ones; equal
    spans never drop each other and partial overlaps stay.
    """
    begin = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(-1.0).alias("score"))
    inside = lambda acc, s: (acc["end"] >= s["end"]) & (acc["score"] >= s["score"]) & ((acc["start"] < s["start"]) | (acc["end"] > s["end"]))

    def step(acc: Column, s: Column) -> Column:
        wider = ~inside(acc, s) & ((s["end"] > acc["end"]) | ((s["end"] == acc["end"]) & (s["score"] > acc["score"])))
        return F.struct(*[F.when(wider, s[name]).otherwise(acc[name]).alias(name) for name in ("start", "end", "score")])

    order = lambda x: by_position(x, lambda s, i: F.struct(s["start"], -s["end"], i))
    return let(spans, lambda x: F.when(F.size(x) < 2, x).otherwise(_kept(order(x), begin, step, lambda acc, s: ~inside(acc, s))))


def _kept(spans: Column, zero: Column, step: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column]) -> Column:
    """The spans for which ``keep(carry, span)`` holds."""
    flags = lambda x: let(scanned(x, zero, step, keep), lambda f: F.filter(x, lambda s, i: f[i]))
    return let(spans, flags)


def disjoint_spans(spans: Column) -> Column:
    """Longest first at each start, then only spans that begin behind the last kept one."""
    ordered = lambda x: by_position(x, lambda s, i: F.struct(s["start"], s["start"] - s["end"], i))
    step = lambda end, s: F.when(s["start"] >= end, s["end"]).otherwise(end)
    return let(spans, lambda x: F.when(F.size(x) < 2, x).otherwise(_kept(ordered(x), F.lit(-1), step, lambda end, s: s["start"] >= end)))


def dedup_last(spans: Column) -> Column:
    """Of spans with equal offsets only the last to arrive."""

    def last(x: Column) -> Column:
        keys = F.sort_array(F.transform(x, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), (-i).alias("i"))))
        first = lambda k: F.filter(k, lambda y, j: (j == 0) | (k[F.greatest(j - 1, F.lit(0))]["start"] != y["start"]) | (k[F.greatest(j - 1, F.lit(0))]["end"] != y["end"]))
        return F.transform(F.sort_array(F.transform(let(keys, first), lambda y: -y["i"])), lambda i: x[i])

    return let(spans, lambda x: F.when(F.size(x) < 2, x).otherwise(last(x)))


def _ranked(spans: Column) -> Column:
    """array<struct<label, surface, n, i, first>>: each span (place i) with the number of its surface within its label,
    by first (start, end); one span of each surface is its first."""
    keys = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["entity_type"].alias("label"), s["text"].alias("surface"), s["start"].alias("start"), s["end"].alias("end"), i.alias("i"))))
    nothing = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("label", "string"), ("surface", "string"), ("start", "int"), ("end", "int"))])
    same = lambda acc, x: acc["label"].eqNullSafe(x["label"]) & acc["surface"].eqNullSafe(x["surface"]) & acc["start"].isNotNull()
    lead = lambda acc, x: F.struct(x["label"].alias("label"), x["surface"].alias("surface"), *[F.when(same(acc, x), acc[n]).otherwise(x[n]).alias(n) for n in ("start", "end")])
    placed = lambda acc, x: let(lead(acc, x), lambda y: F.struct(y["label"].alias("label"), y["start"].alias("start"), y["end"].alias("end"), y["surface"].alias("surface"), x["i"].alias("i")))
    groups = F.sort_array(scanned(keys, nothing, lead, placed))
    zero = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("surface"), F.lit(0).alias("n"))
    fresh = lambda acc, x: (acc["n"] == 0) | ~acc["label"].eqNullSafe(x["label"]) | ~acc["surface"].eqNullSafe(x["surface"])
    n = lambda acc, x: F.when((acc["n"] > 0) & acc["label"].eqNullSafe(x["label"]), acc["n"] + F.when(fresh(acc, x), 1).otherwise(0)).otherwise(1)
    count = lambda acc, x: F.struct(x["label"].alias("label"), x["surface"].alias("surface"), n(acc, x).alias("n"))
    return scanned(groups, zero, count, lambda acc, x: F.struct(x["label"].alias("label"), x["surface"].alias("surface"), n(acc, x).alias("n"), x["i"].alias("i"), fresh(acc, x).alias("first"), x["start"].alias("start"), x["end"].alias("end")))


def number_surfaces(spans: Column) -> Column:
    """array<struct<label, surface, n>>: surfaces of each label numbered from 1 by first (start, end), in this order."""
    firsts = F.filter(_ranked(spans), lambda x: x["first"])
    ordered = F.sort_array(F.transform(firsts, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), x["surface"].alias("surface"), x["n"].alias("n"))))
    return F.transform(ordered, lambda x: F.struct(x["label"].alias("label"), x["surface"].alias("surface"), x["n"].alias("n")))


def surface_numbers(spans: Column) -> Column:
    """array<int>: for each span in turn the number of its surface within its label."""
    return F.transform(F.sort_array(F.transform(_ranked(spans), lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n")))), lambda x: x["n"])


def spliced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with ``put(span)`` in place of each span, as if replaced from right to left by offsets of the original text
    (of equal starts the first in the array first).

    Where a span reaches into what was already replaced behind it, it swallows so many characters of that: so many are
    still to be left out is what is carried from part to part.
    """

    def parts(t: Column, x: Column) -> Column:
        cut = blocks(t)
        nth = lambda i: x[F.least(i + 1, F.size(x) - 1)]
        to = lambda s, i: F.when(i + 1 < F.size(x), nth(i)["start"]).otherwise(F.greatest(F.length(t), s["end"]))
        item = lambda c: F.transform(x, lambda s, i: F.struct(F.concat(put(s), between(c, s["end"], to(s, i))).alias("text"), F.greatest(s["end"] - to(s, i), F.lit(0)).alias("over")))
        out = lambda items: scanned(items, F.lit(0), lambda drop, p: p["over"] + F.greatest(drop - F.length(p["text"]), F.lit(0)), lambda drop, p: F.when(drop > 0, F.substr(p["text"], drop + 1, F.length(p["text"]))).otherwise(p["text"]))
        return let(cut, lambda c: F.concat(between(c, F.lit(0), x[0]["start"]), F.array_join(let(item(c), out), "")))

    ordered = by_position(spans, lambda s, i: F.struct(s["start"], -i))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(text.alias("t"), ordered.alias("x")), lambda y: parts(y["t"], y["x"])))
