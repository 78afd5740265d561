"""Detectors: text to span arrays, and span tables of other detectors brought together with them."""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import labels, presets
from maskwright.functions import spans as S
from maskwright.functions.arrow import appended, sliced
from maskwright.functions.joins import grown
from maskwright.functions.patterns import CLASS_GATES, NEEDS, PRESETS, trait
from maskwright.plans.config import MaskConfig

# Characters that count as Japanese, space, ambiguous names, and types of tagger classes.
JAPANESE = "[぀-ゟ゠-ヿ一-鿿ㇰ-ㇿ･-ﾟ]"
SPACE = "(?U)[\\s\\x1c-\\x1f]"
AMBIGUOUS = ["千葉", "神戸", "岡山", "福岡"]
POS_TYPES = {"人名": "PERSON", "地名": "LOCATION", "組織": "ORG"}
NER_TYPES = {"PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "LOCATION": "LOCATION", "ORG": "ORG", "ORGANIZATION": "ORG"}


def _gate(category: str, pattern: str, literals: tuple[str, ...]) -> Callable[[Column], Column] | None:
    """Whether a text (struct of ``t`` and traits) may match: the pattern's traits first, then its literals."""

    def holds(x: Column, literal: str) -> Column:
        found, name = x["t"].contains(literal), trait(literal)
        return x[name] & found if name else found

    if pattern.startswith("(?<!"):
        return None
    if literals:
        some = lambda x: reduce(lambda a, b: a | b, [holds(x, g) for g in literals])
    elif category in CLASS_GATES:
        some = lambda x: x["t"].rlike(CLASS_GATES[category])
    else:
        return None
    return (lambda x: x[NEEDS[category]] & some(x)) if category in NEEDS else some


def _chosen(disabled: list[str] | None, only: list[str] | None) -> list[int]:
    return [k for k, p in enumerate(PRESETS) if p[0] not in (disabled or ()) and (only is None or p[0] in only)]


def preset_spans(text: Column, disabled: list[str] | None = None, dialect: str = "gateway", only: list[str] | None = None, resolve: bool = False) -> Column:
    """All enabled presets in order; a pattern runs only where the text holds its gate. With ``resolve`` overlaps are resolved."""
    chosen = _chosen(disabled, only)
    return presets.spans(text, chosen, dialect, resolve) if chosen else S.none()


def filtered_presets(text: Column, cfg: MaskConfig) -> Column:
    """The presets with overlaps resolved, filtered and numbered as by ``filters.filtered``, in the same pass."""
    chosen = _chosen(cfg.disabled, None)
    return presets.function_of(filtering(cfg))(text) if chosen else S.none()


def filtering(cfg: MaskConfig) -> Callable[[pa.Array], pa.Array]:
    """``filtered_presets`` of an array of texts."""
    chosen, classes = _chosen(cfg.disabled, None), labels.flat(labels.CLASSES)
    kept = frozenset(k for k in chosen if classes.get(PRESETS[k][1], "other") in cfg.classes) if cfg.min_score <= 1 else frozenset()
    return presets.finder(chosen, cfg.dialect, True, presets.Chosen(kept, frozenset(cfg.blocklist), cfg.dialect == "standalone"))


def pattern_spans(text: Column, patterns: list[list[str]], dialect: str = "gateway") -> Column:
    """User patterns [type, regex]; entries with fewer than two items are left out."""
    return S.patterns_spans(text, [(p[0], p[1], None) for p in patterns if len(p) >= 2], dialect, source="user")


def regex_detector(text: Column, cfg: MaskConfig) -> Column:
    """Presets, then user patterns."""
    parts = ([preset_spans(text, cfg.disabled, cfg.dialect)] if cfg.presets else []) + ([pattern_spans(text, cfg.regex_patterns, cfg.dialect)] if cfg.regex_patterns else [])
    return F.concat(*parts) if parts else S.none()


def chains_of_each(texts: Column, cfg: MaskConfig) -> Column:
    """array<array<span>>: the default chain's spans of each text of an array. The presets can't be looked for within a lambda, so
    they go over the whole array."""
    chosen = _chosen(cfg.disabled, None) if cfg.presets else []
    safe = F.transform(texts, S.safe)
    if not chosen:
        return F.transform(safe, lambda t: S.resolve_overlaps(pattern_spans(t, cfg.regex_patterns, cfg.dialect)) if cfg.regex_patterns else S.none())
    found = presets.spans_of_each(safe, chosen, cfg.dialect, resolve=not cfg.regex_patterns)
    if not cfg.regex_patterns:
        return found
    both = lambda t, x: S.resolve_overlaps(F.concat(x, pattern_spans(t, cfg.regex_patterns, cfg.dialect)))
    return S.let(found, lambda p: F.transform(safe, lambda t, i: both(t, p[i])))


def detect_language(text: Column, ja_threshold: float = 0.2) -> Column:
    """ja, en or mixed, from the share of Japanese characters among those that are no space."""
    dense = F.regexp_replace(text, SPACE, "")
    n = F.length(dense)
    ja = n - F.length(F.regexp_replace(dense, JAPANESE, ""))
    return F.when(text.isNull() | (n == 0), "en").when(ja / n >= ja_threshold, "ja").when(ja == 0, "en").otherwise("mixed")


def entity_type_for(category: Column) -> Column:
    """Label of a force-list category; unknown ones count as OTHER."""
    return F.concat(F.lit("USER_DEFINED_"), F.when(F.upper(category).isin(labels.USER_CATEGORIES), F.upper(category)).otherwise("OTHER"))


def force_list_spans(text: Column, entries: list[tuple[str, str | None]]) -> Column:
    """Spans of a small force list [(value, category)] as a Column."""
    found = [S.literal_spans(text, F.lit(v), entity_type_for(F.lit(c))) for v, c in entries if v]
    return F.concat(*found) if found else S.none()


#: Entries and characters of a list that one automaton takes (some 250 MB at most), and automata that a list may need.
LIST_ROWS, LIST_CHARS, LIST_PARTS = 400_000, 4_000_000, 8
#: Characters of the grams by which longer lists are joined.
GRAM = 6
FOUND = "array<struct<k:bigint,label:string,start:int,end:int,text:string>>"


def with_occurrences(docs: DataFrame, entries: DataFrame, text_col: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with the occurrences of the values of a list (value, category) in each text: array<struct<k, label, start, end, text>>
    in order of entry and place, empty where there are none. The occurrences of a value don't overlap.

    They come as a column of the same row, whatever ids rows have, repeated or none. A list within ``LIST_PARTS`` times
    ``LIST_ROWS`` and ``LIST_CHARS`` goes over each text as automata, one at a time, without a shuffle. With a longer one a text
    meets a value only if it holds that one of the value's grams that the fewest texts hold.
    """
    e = entries.where(F.length("value") > 0).select("value", entity_type_for(F.col("category")).alias("label"))
    size = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // LIST_ROWS), -(-size["chars"] // LIST_CHARS))
    if parts <= LIST_PARTS:
        # several automata are built for each batch, not for each slice of one
        return appended(docs, [text_col], _by_automata(docs, e.toArrow(), parts), into, FOUND, whole=parts > 1)
    return _by_rarest_gram(docs, e.withColumn("k", F.monotonically_increasing_id()), text_col, into)


def occurrences(docs: DataFrame, entries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of ``with_occurrences`` for each row whose text holds a value. Joined back by id, rows must have one of their own."""
    return with_occurrences(docs.select(id_col, text_col), entries, text_col, "found").where(F.size("found") > 0).select(id_col, "found")


def _automaton(values: list[str]):
    """An automaton over distinct values, each with its length and places in the list."""
    import ahocorasick

    same: dict[str, list[int]] = {}
    for k, value in enumerate(values):
        same.setdefault(value, []).append(k)
    automaton = ahocorasick.Automaton()
    for value, numbers in same.items():
        automaton.add_word(value, (len(value), numbers))
    if same:
        automaton.make_automaton()
    return automaton


def _hits(automaton, text: str | None) -> list[tuple[int, int, int]]:
    """(place in the list, start, end): those of one value from left to right without overlap."""
    free: dict[int, int] = {}
    own = []
    for last, (size, numbers) in automaton.iter(text) if text and len(automaton) else ():
        if last + 1 - size >= free.get(numbers[0], 0):
            free[numbers[0]] = last + 1
            own += [(k, last + 1 - size, last + 1) for k in numbers]
    return sorted(own)


def _lists(rows: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.Array:
    """An array of lists of structs, from a list of tuples for each row."""
    flat = [x for row in rows for x in row]
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    columns = [pa.array(c, t) for c, t in zip(zip(*flat) if flat else [()] * len(kinds), kinds)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=names))


def _by_automata(docs: DataFrame, listed: pa.Table, parts: int) -> Callable[[], Callable[[pa.Array], pa.Array]]:
    step = -(-max(1, listed.num_rows) // parts)
    shared = docs.sparkSession.sparkContext.broadcast([listed.slice(k * step, step).combine_chunks() for k in range(parts)])

    def make() -> Callable[[pa.Array], pa.Array]:
        tables = shared.value
        values, labels_ = (pa.concat_arrays([c for t in tables for c in t.column(n).chunks] or [pa.array([], pa.string())]) for n in ("value", "label"))
        build = lambda k: _automaton(tables[k].column("value").to_pylist())
        only = build(0) if parts == 1 else None

        def run(texts: pa.Array) -> pa.Array:
            # hits stay plain numbers, and texts are taken up slice by slice: a batch may hold many
            rows = [array("q") for _ in range(len(texts))]
            for k in range(parts):
                automaton, into = only or build(k), iter(rows)
                for part in sliced(pa.RecordBatch.from_arrays([texts], names=["t"])):
                    for text, own in zip(part.column(0).to_pylist(), into):
                        own.extend(x for n, start, end in _hits(automaton, text) for x in (k * step + n, start, end))
            ends = pa.array(accumulate((len(own) // 3 for own in rows), initial=0), pa.int32())
            flat = np.frombuffer(b"".join(rows), np.int64).reshape(-1, 3)
            k, start, end = (pa.array(flat[:, n], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.int32())))
            return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([k, labels_.take(k), start, end, values.take(k)], names=["k", "label", "start", "end", "text"]))

        return run

    return make


def _grams(text: Column, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _by_rarest_gram(docs: DataFrame, entries: DataFrame, text_col: str, into: str) -> DataFrame:
    """Texts and values brought together by the values' rarest grams; equal texts are looked at once."""
    key = F.sha2(F.col(f"`{text_col}`"), 256)
    texts = docs.select(key.alias("print"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL").dropDuplicates(["print"])
    short = sorted(r[0] for r in entries.where(F.length("value") < GRAM).select(F.length("value")).distinct().collect())
    of_value = entries.select("k", "value", "label", F.explode(F.when(F.length("value") < GRAM, F.array("value")).otherwise(F.array_distinct(_grams(F.col("value"), GRAM)))).alias("gram"))
    of_text = texts.select("print", F.explode(F.array_distinct(F.concat(*[_grams(F.col("t"), n) for n in (*short, GRAM)]))).alias("gram")).join(grown(of_value.select("gram").distinct()), "gram", "left_semi")
    held = of_value.join(grown(of_text.groupBy("gram").agg(F.count("*").alias("n"))), "gram", "left")
    # a gram that no text holds: neither does one hold the value
    rarest = held.groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"), F.first("value").alias("value"), F.first("label").alias("label")).where("r.n > 0")
    met = of_text.join(grown(rarest.select("k", "value", "label", F.col("r.gram").alias("gram"))), "gram")
    each = met.groupBy("print").agg(F.sort_array(F.collect_list(F.struct("k", "label", "value"))).alias("list"))
    hits = each_occurrence(texts.join(grown(each), "print").select(F.col("print").alias("__print"), "t", "list", F.transform("list", lambda x: x["value"]).alias("values")), "t", "values", "hits")
    item = lambda h: F.struct(F.element_at("list", h["i"] + 1)["k"].alias("k"), F.element_at("list", h["i"] + 1)["label"].alias("label"), h["start"].alias("start"), h["end"].alias("end"), F.element_at("list", h["i"] + 1)["value"].alias("text"))
    found = hits.select("__print", F.transform("hits", item).alias("__found"))
    out = docs.drop(into).withColumn("__print", key).join(grown(found), "__print", "left")
    return out.withColumn(into, F.coalesce("__found", F.array().cast(FOUND))).drop("__print", "__found")


def each_occurrence(df: DataFrame, text_col: str, values_col: str, into: str) -> DataFrame:
    """``df`` with array<struct<i, start, end>>: the occurrences of each row's own values in its text, by an automaton for each row."""

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [_hits(_automaton([v or "" for v in own]), t) if own else [] for t, own in zip(texts.to_pylist(), lists.to_pylist())]
        return _lists(rows, [pa.int32(), pa.int32(), pa.int32()], ["i", "start", "end"])

    return appended(df, [text_col, values_col], lambda: run, into, "array<struct<i:int,start:int,end:int>>")


def literal_spans(docs: DataFrame, entries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of a force-list table (value, category), for documents that hold one of its values."""
    return occurrences(docs, entries, id_col, text_col).select(id_col, listed_spans(F.col("found")).alias("spans"))


def listed_spans(found: Column) -> Column:
    """The spans of a column of ``with_occurrences``."""
    return F.transform(found, lambda x: S.span(x["label"], x["start"], x["end"], F.lit(1.0), x["text"], "literal"))


def token_spans(tokens: DataFrame, pos_patterns: list[list[str]] | None = None) -> DataFrame:
    """(doc_id, idx, entity_type, start, end, score, text) of tokens (surface, begin, end, pos) with one of the POS prefixes."""
    prefixes = pos_patterns or [["名詞", "固有名詞"]]
    match = reduce(lambda a, b: a | b, [F.slice("pos", 1, len(p)) == F.array(*map(F.lit, p)) for p in prefixes])
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in POS_TYPES.items() for x in kv]), F.try_element_at("pos", F.lit(3)))
    label = F.when(kind.isNotNull(), F.concat(F.lit("PROPER_NOUN_"), kind)).otherwise("PROPER_NOUN")
    return tokens.where(match).select("doc_id", "idx", label.alias("entity_type"), F.col("begin").alias("start"), "end", F.lit(1.0).alias("score"), F.col("surface").alias("text"))


def prefer_surname(spans: DataFrame) -> DataFrame:
    """Four place names that are surnames as well become persons."""
    both = (F.col("entity_type") == "PROPER_NOUN_LOCATION") & F.col("text").isin(AMBIGUOUS)
    return spans.withColumn("entity_type", F.when(both, "PROPER_NOUN_PERSON").otherwise(F.col("entity_type")))


def piece_offsets(text: Column, pieces: Column) -> Column:
    """array<struct<start,end>> of word pieces, with empty spans for the two outer markers.

    Where the next piece begins is looked up by place: the text is split once where space begins or ends, and each place of
    a stretch of space leads to its end.
    """
    stretches = F.filter(F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)", -1), lambda p: p != "")
    leads = lambda p, at: F.when(p.rlike(r"^\s"), F.array_repeat(at + F.length(p), F.length(p))).otherwise(F.sequence(at, at + F.length(p) - 1))
    places = lambda p: F.flatten(S.scanned(p, F.lit(0), lambda at, x: at + F.length(x), lambda at, x: leads(x, at)))
    body = lambda piece: F.when(piece.startswith("##"), F.length(piece) - 2).otherwise(F.length(piece))

    def offsets(next_: Column) -> Column:
        begin = lambda at: F.coalesce(F.get(next_, at), at)
        inner = S.scanned(pieces, F.lit(0), lambda at, x: begin(at) + body(x), lambda at, x: F.struct(begin(at).alias("start"), (begin(at) + body(x)).alias("end")))
        last = lambda x: F.coalesce(F.get(x, F.size(x) - 1)["end"], F.lit(0))
        return S.let(inner, lambda x: F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), x, F.array(F.struct(last(x).alias("start"), last(x).alias("end")))))

    return S.let(S.let(stretches, places), offsets)


#: Tokens of a document that are merged in one task.
TOKENS = 65_536


def bio_spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, entity_group, start, end, score) from tagged tokens (doc_id, idx, tag, score, start, end).

    A span opens on B, on a change of type and after a tag that is none; tokens with bad offsets are skipped. Documents are
    merged in stretches of ``TOKENS`` numbers, so that a very long one is spread over tasks; only each stretch's last piece, and a
    first one that may go on from the stretch before, then meet by document.
    """
    tag = lambda k: F.regexp_extract("tag", "^([BIE])-(.+)$", k)
    t = tokens.select("*", tag(1).alias("prefix"), tag(2).alias("type"), F.floor(F.col("idx") / TOKENS).alias("stretch")).where((tag(1) == "") | F.coalesce(F.col("end") > F.col("start"), F.lit(False)))
    w = Window.partitionBy("doc_id", "stretch").orderBy("idx")
    goes_on = F.col("prefix").isin("I", "E")
    opens = ~goes_on | ~F.coalesce(F.lag("type").over(w) == F.col("type"), F.lit(False))
    t = t.withColumn("goes_on", goes_on).withColumn("island", F.sum(opens.cast("int")).over(w)).withColumn("last", F.lead(F.lit(False), 1, True).over(w))
    pieces = t.groupBy("doc_id", "stretch", "island").agg(
        F.first("type").alias("entity_group"), F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.sum(F.coalesce("score", F.lit(0.0))).alias("sum"), F.count("*").alias("n"),
        F.bool_or("last").alias("last"), F.min_by("goes_on", "idx").alias("goes_on"),
    )
    asks = (F.col("island") == 1) & F.col("goes_on")
    pieces = pieces.withColumn("asks", asks).withColumn("lane", F.when(F.col("last") | F.coalesce("asks", F.lit(False)), -1).otherwise(F.col("stretch")))  # -1: all that may meet
    w = Window.partitionBy("doc_id", "lane").orderBy("stretch", "island")
    chained = F.coalesce(F.col("asks") & (F.lag("entity_group").over(w) == F.col("entity_group")), F.lit(False))
    at = F.struct("stretch", "island")
    merged = pieces.withColumn("span", F.sum((~chained).cast("int")).over(w)).where(F.col("entity_group") != "").groupBy("doc_id", "lane", "span")
    return merged.agg(F.first("entity_group").alias("entity_group"), F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), (F.sum("sum") / F.sum("n")).alias("score")).drop("lane", "span")


def map_ner_labels(groups: DataFrame) -> DataFrame:
    """Known groups as PROPER_NOUN labels; other groups and empty spans are dropped."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in NER_TYPES.items() for x in kv]), F.upper("entity_group"))
    return groups.withColumn("entity_type", F.concat(F.lit("PROPER_NOUN_"), kind)).where(F.col("entity_type").isNotNull() & (F.col("end") > F.col("start"))).drop("entity_group")


def gathered(table: DataFrame, source: str, order: list[str] | None = None) -> DataFrame:
    """(doc_id, spans): a span table as one array for each document, in order of position."""
    by = [F.col(c) for c in (order or ["start", "end", "entity_type"])]
    fields = ["start", "end", "entity_type", "score", "text"]
    item = F.struct(*([] if order is None else [c.alias(f"k{i}") for i, c in enumerate(by)]), *fields)
    found = lambda x: S.span(*[x[name] for name in ("entity_type", "start", "end", "score", "text")], source)
    return table.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(item)), found).alias(source))


def union_spans(docs: DataFrame, table: DataFrame, source: str, entity_types: list[str] | None = None) -> DataFrame:
    """``docs`` with the spans of another detector as a column named ``source``; documents without any get none."""
    kept = table if entity_types is None else table.where(F.col("entity_type").isin(entity_types))
    return docs.join(grown(gathered(kept, source)), "doc_id", "left").withColumn(source, F.coalesce(F.col(source), S.none()))


def default_chain(text: Column, cfg: MaskConfig, statistical: Column | None = None, tokens: Column | None = None, others: list[Column] | None = None) -> Column:
    """Statistical spans, tokens, spans of others and regex spans, with overlaps resolved after each further source."""
    if statistical is None and tokens is None and not others and cfg.presets and not cfg.regex_patterns:
        return preset_spans(text, cfg.disabled, cfg.dialect, resolve=True)
    out = statistical if statistical is not None else S.none()
    more = ([tokens] if tokens is not None else []) + (others or []) + ([regex_detector(text, cfg)] if cfg.presets or cfg.regex_patterns else [])
    for source in more:
        out = presets.joined([F.coalesce(out, S.none()), F.coalesce(source, S.none())], always=True)
    return out


def language_chain(text: Column, cfg: MaskConfig, sources: dict[str, Column] | None = None) -> Column:
    """Spans of the chain for the detected language; overlaps are resolved if two detectors found something.

    A language without a chain falls back to mixed, then en, then none. Presets bring the regex detector into every chain.
    """
    every = dict(sources or {})
    regex = regex_detector(text, cfg)
    chains = cfg.chains or {}

    def chain(names: list[str]) -> Column:
        names = names + ["regex"] * (cfg.presets and "regex" not in names)
        cols = [regex if n == "regex" else every[n] for n in names if n != "regex" or cfg.presets or cfg.regex_patterns]
        if not cols:
            return S.none()
        return cols[0] if len(cols) == 1 else presets.joined([F.coalesce(c, S.none()) for c in cols], always=False)

    rest = chains.get("mixed", chains.get("en", []))
    options = {lang: tuple(chains.get(lang, rest)) for lang in ("ja", "en", "mixed")}
    found = {names: chain(list(names)) for names in options.values()}
    lang, out = detect_language(text, cfg.ja_threshold), found[options["mixed"]]
    for name in ("en", "ja"):  # languages with the chain of mixed texts aren't told apart from these
        out = out if options[name] == options["mixed"] else F.when(lang == name, found[options[name]]).otherwise(out)
    return out
