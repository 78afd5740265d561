"""Masked text from span arrays, as Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.arrow import appended, sliced
from maskwright.functions.udf import Detector
from maskwright.plans.config import MaskConfig

from . import detect, filters
from .surrogate import fake, surrogate


def tag_mask(text: Column, spans: Column) -> Column:
    """<TYPE_N>, numbered by first occurrence of a surface; of equal spans the last one gives the type."""
    return S.let(spans, lambda x: _tagged(text, x, S.surface_numbers(x), S.dedup_last))


def _tagged(text: Column, spans: Column, numbers: Column, chosen=lambda x: x) -> Column:
    """The spans that ``chosen`` leaves as tags, with a number for each span."""
    tag = lambda s, n: F.concat(F.lit("<"), s["entity_type"], F.lit("_"), F.coalesce(n, F.lit(1)).cast("string"), F.lit(">"))
    tags = S.let(numbers, lambda n: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(s, n[i]).alias("put"))))
    return S.spliced(text, chosen(tags), lambda s: s["put"])


def _with_tags(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """``tag_mask`` of a text and its (entity type, start, end, surface)."""
    first: dict[tuple[str, str], tuple[int, int]] = {}
    for label, start, end, surface in spans:
        key = (label, surface)
        first[key] = min(first.get(key, (start, end)), (start, end))
    size: dict[str, int] = {}
    number = {}
    for key in sorted(first, key=lambda k: (first[k], k[1])):
        number[key] = size[key[0]] = size.get(key[0], 0) + 1
    return _put(text, [(start, -i, end, f"<{label}_{number[label, surface]}>") for i, (label, start, end, surface) in _last(spans)])


def _last(spans: list[tuple[str, int, int, str]]) -> list[tuple[int, tuple[str, int, int, str]]]:
    """The spans with their places, of those with equal offsets only the last to arrive."""
    return sorted({(x[1], x[2]): (i, x) for i, x in enumerate(spans)}.values())


def _put(text: str, edits: list[tuple[int, int, int, str]]) -> str:
    """``spans.spliced`` of (start, less its place, end, text to put there)."""
    edits.sort()
    out, drop = [text[: max(edits[0][0], 0)]], 0
    for k, (_, _, end, put) in enumerate(edits):
        to = edits[k + 1][0] if k + 1 < len(edits) else max(len(text), end)
        part = put + text[max(end, 0) : max(to, 0)]
        out.append(part[drop:])
        drop = max(end - to, 0) + max(drop - len(part), 0)
    return "".join(out)


def _with_stars(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """``partial_mask``: one span after the other, as lengths stay."""
    out = [*text]
    for _, start, end, surface in spans:
        n = len(surface)
        out[start:end] = "*" * n if n <= 2 else [surface[0], *"*" * (n - 2), surface[-1]]
    return "".join(out)


def _with_hashes(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    return _put(text, [(start, -i, end, f"<{label}:{sha256(surface.encode()).hexdigest()[:10]}>") for i, (label, start, end, surface) in _last(spans)])


def _with_surrogates(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """``surrogate_mask``: the longest first at each start, then only spans behind the last kept one."""
    edits, to = [], -1
    for i, (label, start, end, surface) in sorted(_last(spans), key=lambda x: (x[1][1], -x[1][2], x[0])):
        if start >= to:
            to = end
            edits.append((start, -i, end, fake(label, surface) or surface))
    return _put(text, edits)


_BY_ROW = {"tag": _with_tags, "partial": _with_stars, "hash": _with_hashes, "surrogate": _with_surrogates}


def masker(other: str | None = None):
    """A function of (text, spans, strategy) over Arrow batches, with the results of ``apply_strategy`` for spans without nulls, such as the
    presets give. Unknown strategies count as ``other``, or leave a text as it is."""

    def run(texts: pa.Array, spans: pa.Array, strategies: pa.Array) -> pa.Array:
        out = []
        for b in sliced(pa.RecordBatch.from_arrays([texts, spans, strategies], names=["t", "s", "by"])):
            out += _masked(*b.columns, other)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def _masked(texts: pa.Array, spans: pa.Array, strategies: pa.Array, other: str | None) -> list[str | None]:
    label, start, end, _, surface, _, _ = (c.to_pylist() for c in spans.flatten().flatten())
    out, at = [], 0
    for text, n, by in zip(texts.to_pylist(), pc.fill_null(pc.list_value_length(spans), 0).to_pylist(), strategies.to_pylist()):
        mask = _BY_ROW.get(by) or _BY_ROW.get(other)
        out.append(mask(text, [*zip(label[at : at + n], start[at : at + n], end[at : at + n], surface[at : at + n])]) if mask and n and text is not None else text)
        at += n
    return out


def plain(cfg: MaskConfig) -> bool:
    """Whether the presets alone say what is masked."""
    return cfg.filter_enabled and cfg.presets and cfg.chains is None and not cfg.regex_patterns and not cfg.allow_types and cfg.overlap == "reference"


def masking(cfg: MaskConfig, other: str | None = None) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """The masked texts of an array, with a strategy for each, of ``plain`` settings: spans are found and put to use in one step."""
    find = detect.filtering(cfg)

    def run(texts: pa.Array, strategies: pa.Array) -> pa.Array:
        out = []
        for b in sliced(pa.RecordBatch.from_arrays([texts, strategies], names=["t", "by"])):
            out += _masked(b.column(0), find(pc.replace_substring(b.column(0), S.MARK, S.SPARE)), b.column(1), other)
        return pa.array(out, pa.string())

    return run


def masker_of_texts(cfg: MaskConfig, other: str | None = None):
    """``masking`` as a function of (text, strategy) that can be registered for SQL."""
    mask = masking(cfg, other)

    def run(texts: pa.Array, strategies: pa.Array) -> pa.Array:
        return mask(texts, strategies)

    return F.arrow_udf(run, "string")


def masked_lists(df: DataFrame, texts_col: str, cfg: MaskConfig, into: str) -> DataFrame:
    """``df`` with each text of an array<string> masked on its own, of ``plain`` settings."""

    def make() -> Callable[[pa.Array], pa.Array]:
        mask = masking(cfg)

        def run(lists: pa.Array) -> pa.Array:
            texts, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0)
            ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
            return pa.ListArray.from_arrays(ends, mask(texts, pa.repeat(pa.scalar(cfg.strategy), len(texts))), mask=pc.is_null(lists))

        return run

    return appended(df, [texts_col], make, into, "array<string>")


def tagged_texts(df: DataFrame, found_col: str, into: str) -> DataFrame:
    """``df`` with an array<string>: each text of an array<struct<t, s>> with ``tag_mask`` of its spans, over Arrow batches."""

    def run(lists: pa.Array) -> pa.Array:
        texts, spans = lists.flatten().flatten()
        label, start, end, _, surface, _, _ = (c.to_pylist() for c in spans.flatten().flatten())
        out, at = [], 0
        for text, n in zip(texts.to_pylist(), pc.fill_null(pc.list_value_length(spans), 0).to_pylist()):
            out.append(_with_tags(text, [*zip(label[at : at + n], start[at : at + n], end[at : at + n], surface[at : at + n])]) if n and text is not None else text)
            at += n
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(ends, pa.array(out, pa.string()), mask=pc.is_null(lists))

    return appended(df, [found_col], lambda: run, into, "array<string>")


def numbered_mask(text: Column, spans: Column, numbers: Column) -> Column:
    """As ``tag_mask``, with a given number for each span."""
    return S.let(spans, lambda x: _tagged(text, x, numbers, S.dedup_last))


def partial_mask(text: Column, spans: Column) -> Column:
    """First and last character kept, stars between; up to two characters all stars. Lengths stay.

    Where spans overlap, the last to arrive shows: they are put in one after the other, all others in one go.
    """

    def masked(s: Column) -> Column:
        n = F.length(s["text"])
        return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(s["text"], F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(s["text"], F.lit(1))))

    def put(x: Column) -> Column:
        order = F.sort_array(F.transform(x, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"))))
        reach = lambda o: S.scanned(o, F.lit(-1), lambda end, s: F.greatest(end, s["end"]), lambda end, s: end)
        touched = lambda o, r: F.transform(o, lambda s, j: F.struct(s["i"].alias("i"), ((r[j] > s["start"]) | (F.coalesce(F.get(o, j + 1)["start"], s["end"]) < s["end"])).alias("over")))
        flags = S.let(order, lambda o: S.let(reach(o), lambda r: F.transform(F.sort_array(touched(o, r)), lambda f: f["over"])))
        alone = lambda f: S.spliced(text, F.filter(x, lambda s, i: ~f[i]), masked)
        one = lambda acc, s: F.concat(F.substr(acc, F.lit(1), s["start"]), masked(s), F.substr(acc, s["end"] + 1, F.length(acc)))
        return S.let(flags, lambda f: F.aggregate(F.filter(x, lambda s, i: f[i]), alone(f), one))

    return F.when(F.size(spans) == 0, text).otherwise(S.let(spans, put))


def hash_mask(text: Column, spans: Column) -> Column:
    """<TYPE:10 hex digits>; equal spans are replaced once."""
    put = lambda s: F.concat(F.lit("<"), s["entity_type"], F.lit(":"), F.substring(F.sha2(s["text"], 256), 1, 10), F.lit(">"))
    return S.spliced(text, S.dedup_last(spans), put)


def surrogate_mask(text: Column, spans: Column) -> Column:
    """Deterministic values of the same type; disjoint spans only."""
    return S.spliced(text, S.disjoint_spans(S.dedup_last(spans)), lambda s: F.coalesce(surrogate(s["entity_type"], s["text"]), s["text"]))


STRATEGIES = {"tag": tag_mask, "partial": partial_mask, "hash": hash_mask, "surrogate": surrogate_mask}


def apply_strategy(text: Column, spans: Column, strategy: str | Column) -> Column:
    """The text masked by a strategy, or by one for each row; unknown strategies leave it as it is."""
    if isinstance(strategy, str):
        return STRATEGIES[strategy](text, spans) if strategy in STRATEGIES else text
    out = text
    for name, mask in STRATEGIES.items():
        out = F.when(strategy == name, mask(text, spans)).otherwise(out)
    return out


def mask_triples(text: Column, triples: Column) -> Column:
    """Chosen array<struct<start,end,label>> as numbered tags; bad offsets are skipped, a missing label is MASKED."""
    span = lambda cut, t: S.span(F.coalesce(t["label"], F.lit("MASKED")), t["start"], t["end"], F.lit(1.0), S.between(cut, t["start"], t["end"]))
    spans = S.let(S.blocks(text), lambda cut: F.transform(S.valid_spans(triples, text), lambda t: span(cut, t)))
    return S.let(spans, lambda x: _tagged(text, x, S.surface_numbers(x)))


def sanitize(docs: DataFrame, cfg: MaskConfig | None = None, text_col: str = "text", statistical: str | None = None, tokens: str | None = None, demoted: str | None = None, strategy_col: str | None = None, detectors: Sequence[Detector] = (), report: bool = True) -> DataFrame:
    """``docs`` with ``spans`` (all reported) and ``sanitized_text``: one projection, no shuffle, batch or stream.

    Other detectors' spans come in as array columns named by ``statistical`` and ``tokens``. ``detectors`` are the user's own:
    the chains of ``cfg`` call them by name; without chains they come before the presets, overlaps resolved after each.
    With ``report=False`` there is no column ``spans``; those of the presets then never leave Python.
    """
    cfg = cfg or MaskConfig()
    raw = F.col(f"`{text_col}`")
    if not report:
        if plain(cfg) and not detectors and statistical is tokens is demoted is None:
            by = F.coalesce(F.col(strategy_col), F.lit(cfg.strategy)) if strategy_col else F.lit(cfg.strategy)
            return docs.withColumn("sanitized_text", masker_of_texts(cfg)(raw, by))
        return sanitize(docs, cfg, text_col, statistical, tokens, demoted, strategy_col, detectors).drop("spans")
    if not cfg.filter_enabled:
        return docs.withColumn("spans", S.none()).withColumn("sanitized_text", raw)
    text = F.col("__safe")
    stat, toks = (F.col(c) if c else None for c in (statistical, tokens))
    out = docs.withColumn("__safe", S.safe(raw))
    own = {d.name: F.col(f"`__by_{d.name}`") for d in detectors}
    for d in detectors:
        out = out.withColumn(f"__by_{d.name}", F.coalesce(d.spans(text), S.none()))
    spans = None
    if cfg.chains is None and cfg.presets and not cfg.regex_patterns and not detectors and statistical is tokens is demoted is None:
        spans = detect.filtered_presets(text, cfg)
    elif cfg.chains is not None:
        found = detect.language_chain(text, cfg, {"statistical": stat if stat is not None else S.none(), "tokens": toks if toks is not None else S.none()} | own)
    else:
        found = detect.default_chain(text, cfg, stat, toks, list(own.values()))
    out = out.withColumn("spans", S.numbered(filters.filtered(found, cfg, F.col(demoted) if demoted else None)) if spans is None else spans)
    chosen = filters.maskable(F.col("spans"), cfg.allow_types)
    if cfg.overlap == "disjoint":
        chosen = S.disjoint_spans(S.dedup_last(chosen))
    # a column of its own: nested in the mask, the two would take more rounds to analyse than Spark allows
    out = out.withColumn("__chosen", chosen)
    strategy = F.coalesce(F.col(strategy_col), F.lit(cfg.strategy)) if strategy_col else F.lit(cfg.strategy)
    if spans is not None and cfg.overlap == "reference":
        # without nulls, and found by Python, which masks as well; where only the text is asked for, spans don't leave it meanwhile
        masked = masker()(raw, F.col("__chosen"), strategy)
    else:
        masked = F.when(F.size("spans") > 0, apply_strategy(raw, F.col("__chosen"), strategy if strategy_col else cfg.strategy)).otherwise(raw)
    return out.withColumn("sanitized_text", masked).drop("__safe", "__chosen", *[f"__by_{d.name}" for d in detectors])


def placeholder_map(docs: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """(doc_id, placeholder, surface): what makes the tags of a document restorable."""
    numbers = S.unfolded(docs, S.number_surfaces(F.col(spans_col)), id_col)
    return numbers.select(id_col, F.concat(F.lit("<"), "label", F.lit("_"), F.col("n").cast("string"), F.lit(">")).alias("placeholder"), "surface")


# Tag names of a language model's entity types.
BASES = {"PERSON": "name", "COMPANY": "company", "LOCATION": "location", "DEPARTMENT": "department", "PROJECT_CODE": "project", "CREDENTIAL": "credential", "SENSITIVE_FACT": "fact", "PHONE_NUMBER": "phone", "EMAIL_ADDRESS": "email"}


def unique_tags(replacements: Column) -> Column:
    """array<struct<original, replacement, entity_type>> with one numbered tag for each distinct trimmed original."""
    base_of = F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv])
    keyed = F.filter(
        F.transform(
            replacements,
            lambda r: F.struct(
                F.regexp_replace(r["original"], r"(?U)^\s+|\s+$", "").alias("original"),
                F.when(F.coalesce(r["replacement"].rlike(r"(?i)<[a-z][a-z_]*?(?:_\d+)?>"), F.lit(False)), F.lower(F.regexp_extract(r["replacement"], r"(?i)<([a-z][a-z_]*?)(?:_\d+)?>", 1)))
                .otherwise(F.coalesce(F.try_element_at(base_of, F.upper(r["entity_type"])), F.lit("masked"))).alias("base"),
                r["entity_type"].alias("entity_type"),
            ),
        ),
        lambda r: F.coalesce(r["original"] != "", F.lit(False)),
    )
    return S.let(S.let(keyed, _firsts), _numbered_tags)


def _firsts(rows: Column) -> Column:
    """The first row of each original, in order."""
    keys = F.sort_array(F.transform(rows, lambda r, i: F.struct(r["original"].alias("original"), i.alias("i"))))
    new = lambda k, x, j: (j == 0) | (k[F.greatest(j - 1, F.lit(0))]["original"] != x["original"])
    places = S.let(keys, lambda k: F.sort_array(F.transform(F.filter(k, lambda x, j: new(k, x, j)), lambda x: x["i"])))
    return F.transform(places, lambda i: rows[i])


def _numbered_tags(rows: Column) -> Column:
    """A tag for each row, numbered within its base: by sorting the bases, and back."""
    keys = F.sort_array(F.transform(rows, lambda r, i: F.struct(r["base"].alias("base"), i.alias("i"))))
    zero = F.struct(F.lit(None).cast("string").alias("base"), F.lit(0).alias("n"))
    count = lambda acc, x: F.struct(x["base"].alias("base"), (F.when(acc["base"].eqNullSafe(x["base"]), acc["n"]).otherwise(0) + 1).alias("n"))
    placed = S.scanned(keys, zero, count, lambda acc, x: F.struct(x["i"].alias("i"), count(acc, x)["n"].alias("n")))
    tag = lambda r, n: F.struct(r["original"].alias("original"), F.concat(F.lit("<"), r["base"], F.lit("_"), n.cast("string"), F.lit(">")).alias("replacement"), r["entity_type"].alias("entity_type"))
    return S.let(F.sort_array(placed), lambda p: F.transform(rows, lambda r, i: tag(r, p[i]["n"])))


def rewrite_with_tags(df: DataFrame, text_col: str = "text", replacements_col: str = "replacements", into: str = "rewritten") -> DataFrame:
    """``df`` with a struct<rewritten_text, replacements>: every occurrence of each original tagged, longest first.

    The occurrences of all originals are found in one pass over the text.
    """
    text = F.col(f"`{text_col}`")
    tagged = df.withColumn("__tags", unique_tags(F.col(f"`{replacements_col}`"))).withColumn("__values", F.transform("__tags", lambda r: r["original"]))
    hits = detect.each_occurrence(tagged, text_col, "__values", "__hits")
    span = lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.element_at("__tags", h["i"] + 1)["replacement"].alias("put"))
    done = S.spliced(text, S.disjoint_spans(F.transform("__hits", span)), lambda s: s["put"])
    return hits.withColumn(into, F.when(text.isNotNull() & F.col("__tags").isNotNull(), F.struct(done.alias("rewritten_text"), F.col("__tags").alias("replacements")))).drop("__tags", "__values", "__hits")
