"""Chat payloads: texts taken out of JSON bodies, masked and put back.

What lies where in a body depends on the service and bodies keep keys of their own. One small Arrow-batched function
(``located``) reads each body once and says where its texts stand; taking out, masking and putting back are Columns, inside
the row. A masked text goes in at its place, so all else of a body stays as it is, to the character.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.arrow import appended
from maskwright.functions.joins import grown
from maskwright.plans.config import MaskConfig

from . import detect, filters, mask

#: For each service the host, the path that sends text, and paths that don't.
SERVICES = [
    ("a", r"(^https?:\/\/claude\.(ai|com)|\.claude\.com)", r"\/(?:completion|append_message|retry_completion|chat_conversations|send_message|messages|send)(?=[\/?#]|$)",
     r"\/(?:title|feedback|star|archive|share|export|leave|rename|latest|preview|render_status|count|stream_events|usage|analytics|telemetry|ratings)(?=[\/?#]|$)"),
    ("b", r"(chatgpt\.com|chat\.openai\.com)", r"\/backend-api\/(?:f\/)?conversation(?:\?[^#]*)?(?:#.*)?$", None),
    ("c", r"gemini\.google\.com", r"(?i)(StreamGenerate|GenerateContent|assistant\.lamda|BardFrontendService)", None),
    ("d", r"(?i)(manus\.im|butterfly-effect\.dev)", r"(?i)\/(?:submit|send|message|messages|completion|chat|rpc|prompt|task|agent|conversation|conversations)(?=[\/?#]|$)",
     r"(?i)\/(?:files?|list|search|feedback|metrics|status|health|heartbeat|preview|thumbnail|avatar|upload)(?=[\/?#]|$)|(sentry|amplitude|analytics|telemetry|segment\.io|datadog|newrelic)"),
]
TOP = {"openai": ["input", "system"], "a": ["prompt", "text", "query", "message"], "b": [], "c": [], "d": ["input", "prompt", "query", "text", "message", "content"]}


def classify_service(url: Column) -> Column:
    """The first service whose matcher takes the URL, or null."""
    out = None
    for name, host, path, deny in SERVICES:
        hit = url.rlike(host) & url.rlike(path)
        hit = hit & ~url.rlike(deny) if deny else hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(None))


def _list(value: Any) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def slots(body: Any, service: str) -> Iterator[tuple[Any, Any]]:
    """(container, key) of each text that the service sends, in order."""
    if not isinstance(body, dict):
        return
    blank = service == "openai"  # which masks blank texts as well

    def held(box: Any, key: Any, empty: bool = blank) -> bool:
        value = box[key] if isinstance(box, list) else box.get(key)
        return isinstance(value, str) and (empty or bool(value.strip()))

    yield from ((body, k) for k in TOP[service] if held(body, k))
    if service == "d":
        yield from ((c, "value") for c in _list(body.get("contents")) if c.get("type") == "text" and held(c, "value"))
    if service == "c":
        for c in _list(body.get("contents")):
            if c.get("role") in ("user", None, ""):
                yield from ((p, "text") for p in _list(c.get("parts")) if held(p, "text"))
        return
    for m in _list(body.get("messages")):
        content = m.get("content")
        if service == "b":
            author = m.get("author")
            if isinstance(author, dict) and author.get("role") == "user" and isinstance(content, dict) and isinstance(content.get("parts"), list):
                yield from ((content["parts"], k) for k in range(len(content["parts"])) if held(content["parts"], k))
        elif isinstance(content, str):
            if service == "openai" or m.get("role") == "user":
                yield m, "content"
        elif service == "openai":
            for p in _list(content):
                if p.get("type") == "text":
                    yield p, "text" if "text" in p else "content"
        else:
            yield from ((p, "text") for p in _list(content) if (p.get("type") == "text" and held(p, "text", True) if service == "a" else held(p, "text")))
    if service == "a":
        yield from ((p, "text") for p in _list(body.get("content")) if p.get("type") == "text" and held(p, "text"))


class Placed(str):
    """A string of a JSON text that knows where its literal stands, quotes included."""

    start: int
    end: int


class Twice(ValueError):
    """An object names a key twice, of which the last counts."""


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Twice
    return found


def _placing() -> json.JSONDecoder:
    """A decoder whose string values are ``Placed``."""
    plain = json.decoder.scanstring

    def string(text: str, at: int, strict: bool = True) -> tuple[Placed, int]:
        value, end = plain(text, at, strict)
        placed = Placed(value)
        placed.start, placed.end = at - 1, end
        return placed, end

    decoder = json.JSONDecoder(object_pairs_hook=_once)
    decoder.parse_string = string
    decoder.scan_once = json.scanner.py_make_scanner(decoder)
    return decoder


#: Levels of nesting up to which bodies are read.
DEEPEST = 5_000


def _parsed(raw: Any, decoder: json.JSONDecoder | None = None) -> Any:
    """The value of a JSON text, or none; also none for what is nested too deeply to be walked."""
    try:
        return decoder.decode(raw) if decoder else json.loads(raw)
    except Twice:
        raise
    except (TypeError, ValueError, RecursionError):
        return None


def _whole(text: str) -> str:
    """The text with lone surrogates, which no column can hold, as U+FFFD."""
    return str(text) if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _nested(body: Any) -> list[str]:
    """Strings at any depth of service C's request string, which can be read but not put back."""
    found: list[str] = []
    todo = [_parsed(body.get("f.req"))] if isinstance(body, dict) and isinstance(body.get("f.req"), str) else []
    while todo:
        at = todo.pop(0)
        if isinstance(at, str) and at.strip():
            found.append(at)
        elif isinstance(at, list):
            todo = [*at, *todo]
    return found


def _at(box: Any, key: Any) -> Any:
    return box[key] if isinstance(box, list) else box.get(key)


def _read(raw: str, service: str, decoder: json.JSONDecoder) -> tuple[str, list[tuple[str, int, int]], list[str], bool]:
    """(body, (text, start, end) of each text to mask, texts that can't be put back, unreadable).

    A body is written anew only where an object names a key twice, or where a text's place holds no string.
    """
    try:
        body = _parsed(raw, decoder)
    except Twice:
        body = _parsed(raw)
        return _read(_whole(json.dumps(body, ensure_ascii=False)), service, decoder) if isinstance(body, dict) else (raw, [], [], False)
    if not isinstance(body, dict):
        return raw, [], [], body is None and raw.strip() != "null"
    found, odd = [], False
    for box, key in slots(body, service):
        value = place = _at(box, key)
        if service == "openai" and key == "text":  # an empty text falls back to the part's content
            value = value or box.get("content")
        if isinstance(place, Placed):
            found.append((_whole(str(value or "")), place.start, place.end))
        else:
            box[key], odd = str(value or ""), True
    if odd:
        return _read(_whole(json.dumps(body, ensure_ascii=False)), service, decoder)
    return raw, found, [_whole(t) for t in _nested(body)] if service == "c" else [], False


LOCATED = "struct<body:string,places:array<struct<text:string,start:int,end:int>>,nested:array<string>,unreadable:boolean>"


def located(df: DataFrame, body_col: str, service: str, into: str = "__at") -> DataFrame:
    """``df`` with what ``_read`` says of each body; nothing is found in null ones."""

    def run(bodies: pa.Array) -> pa.Array:
        decoder = _placing()
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 3 * DEEPEST))
        try:
            rows = [(None, [], [], False) if raw is None else _read(raw, service, decoder) for raw in bodies.to_pylist()]
        finally:
            sys.setrecursionlimit(limit)
        place = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        columns = [[r[0] for r in rows], [[dict(zip(("text", "start", "end"), x)) for x in r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
        kinds = [pa.string(), pa.list_(place), pa.list_(pa.string()), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["body", "places", "nested", "unreadable"])

    return appended(df, [body_col], lambda: run, into, LOCATED)


def _texts(at: Column) -> Column:
    return F.concat(F.transform(at["places"], lambda p: p["text"]), at["nested"])


def put_back(at: Column, masked: Column) -> Column:
    """The body of ``located`` with the texts of an array at their places, in turn; texts that stayed the same aren't touched."""
    literal = lambda m: F.regexp_extract(F.to_json(F.array(m)), r"(?s)^\[(.*)\]$", 1)
    edit = lambda p, m: F.when(m.isNotNull() & (m != p["text"]), F.struct(p["start"].alias("start"), p["end"].alias("end"), literal(m).alias("put")))
    edits = F.array_compact(F.transform(at["places"], lambda p, i: edit(p, F.get(masked, i))))
    return F.coalesce(S.let(edits, lambda x: S.spliced(at["body"], x, lambda s: s["put"])), at["body"])


def extract_inputs(df: DataFrame, body_col: str, service: str, into: str = "texts") -> DataFrame:
    """``df`` with the texts of each body as array<string>; empty for what is no JSON object."""
    return located(df, body_col, service).withColumn(into, _texts(F.col("__at"))).drop("__at")


def replace_inputs(df: DataFrame, body_col: str, masked_col: str, service: str, into: str = "masked_body") -> DataFrame:
    """``df`` with the body whose texts are replaced in turn by those of an array, and ``unreadable``: whether a body was
    passed on as it is, because it is no JSON or nested too deeply."""
    at = F.col("__at")
    return located(df, body_col, service).withColumn(into, put_back(at, F.col(f"`{masked_col}`"))).withColumn("unreadable", at["unreadable"]).drop("__at")


def found_in_texts(texts: Column, cfg: MaskConfig) -> Column:
    """array<struct<t, s>>: each text of an array with the spans to mask."""
    kept = lambda x: filters.maskable(filters.filtered(x, cfg), cfg.allow_types)
    return S.let(detect.chains_of_each(texts, cfg), lambda found: F.transform(texts, lambda t, i: F.struct(t.alias("t"), kept(found[i]).alias("s"))))


def masked_texts(df: DataFrame, found_col: str, cfg: MaskConfig, into: str) -> DataFrame:
    """``df`` with each text of a column of ``found_in_texts`` masked on its own, numbers starting anew."""
    if cfg.strategy == "tag":
        return mask.tagged_texts(df, found_col, into)
    return df.withColumn(into, F.transform(found_col, lambda x: F.when(F.size(x["s"]) > 0, mask.apply_strategy(x["t"], x["s"], cfg.strategy)).otherwise(x["t"])))


def mask_payload(df: DataFrame, body_col: str, service: str = "openai", cfg: MaskConfig | None = None) -> DataFrame:
    """``df`` with ``texts``, ``masked_body``, ``unreadable`` (the body is passed on as it is) and ``unreplaced`` (texts were
    found that can't be put back). Lone surrogates become U+FFFD."""
    cfg, at = cfg or MaskConfig(), F.col("__at")
    out = located(df, body_col, service).withColumn("texts", _texts(at))
    if mask.plain(cfg) and cfg.strategy in mask.STRATEGIES:
        out = mask.masked_lists(out, "texts", cfg, "__masked")
    elif cfg.filter_enabled:
        out = masked_texts(out.withColumn("__found", found_in_texts(F.col("texts"), cfg)), "__found", cfg, "__masked")
    else:
        out = out.withColumn("__masked", F.col("texts"))
    nested = F.size(at["nested"]) > 0
    done = out.withColumn("masked_body", put_back(at, F.col("__masked"))).withColumn("unreadable", at["unreadable"]).withColumn("unreplaced", nested)
    return done.drop("__at", "__found", "__masked")


def text_segments(body: Column) -> Column:
    """Non-empty texts of an OpenAI-like body: input, message strings, text parts (both of their text fields)."""
    shape = "input string, messages array<struct<content:variant>>"
    none = F.array().cast("array<string>")

    def listed(content: Column) -> Column:
        parts = F.from_json(F.to_json(content), "array<struct<type:string,text:string,content:string>>")
        return F.coalesce(F.flatten(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.array(p["text"], p["content"]))), none)

    def of(message: Column) -> Column:
        return F.when(F.schema_of_variant(message["content"]) == "STRING", F.array(F.try_variant_get(message["content"], "$", "string"))).otherwise(listed(message["content"]))

    every = lambda parsed: F.concat(F.array(parsed["input"]), F.coalesce(F.flatten(F.transform(parsed["messages"], of)), none))
    return F.filter(S.let(F.from_json(body, shape), every), lambda t: F.coalesce(t != "", F.lit(False)))


def normalized_text(body: Column) -> Column:
    """The text parts of an answer joined by newlines and trimmed; null without any."""
    parts = F.filter(F.from_json(body, "content array<struct<type:string,text:string>>")["content"], lambda p: p["type"] == "text")
    joined = lambda p: F.array_join(F.transform(p, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    # each end is trimmed only where its outermost character is space: looking for a text's last space tries every one in it
    left = lambda t: F.when(F.left(t, F.lit(1)).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+", "")).otherwise(t)
    right = lambda t: F.when(F.right(t, F.lit(1)).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)\s+$", "")).otherwise(t)
    return S.let(parts, lambda p: F.when(F.size(p) > 0, S.let(S.let(joined(p), left), right)))


#: Turns of a conversation whose surfaces are numbered in one task.
TURNS = 1_024


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are keys like any other value; the keys are those of ``a``."""
    named = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(grown(named), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def mask_conversations(df: DataFrame, spans_of, roles: tuple[str, ...] = ("user",), scope: str = "turn") -> DataFrame:
    """Turns (conv_id, turn, role, text) with ``masked``: turns of the given roles, others as they are.

    ``spans_of`` gives the spans of a text Column. Numbers restart with each turn, or run through a conversation: there
    surfaces are numbered within ``TURNS`` turns each, and what earlier stretches hold is added, so that a conversation of any length is
    spread over tasks. Rows without conversation or turn count as one of their own.
    """
    own = F.col("role").isin(list(roles))
    rows = df.withColumn("spans", F.when(own, S.numbered(spans_of(S.safe(F.col("text"))))).otherwise(S.none()))
    if scope == "turn":
        return rows.withColumn("masked", F.when(F.size("spans") > 0, mask.tag_mask(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    rows = rows.withColumn("print", F.xxhash64("text"))
    each = rows.select("conv_id", "turn", "print", F.explode_outer("spans").alias("s")).where(F.col("s").isNotNull()).select("conv_id", "turn", "print", "s.seq", "s.entity_type", "s.text", "s.start", "s.end")
    first = each.groupBy("conv_id", "entity_type", "text").agg(F.min(F.struct("turn", "start", "end")).alias("at")).withColumn("part", F.floor(F.col("at.turn") / TURNS))
    key = ["conv_id", "entity_type", "part"]
    placed = first.withColumn("own", F.row_number().over(Window.partitionBy(*key).orderBy("at", "text"))).withColumn("size", F.count("*").over(Window.partitionBy(*key)))
    earlier = Window.partitionBy("conv_id", "entity_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.where(F.col("own") == 1).select(*key, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    numbered = _joined(placed, before, key).select("conv_id", "entity_type", "text", (F.col("own") + F.col("before")).alias("n"))
    # back to each turn with only its own numbers: a conversation's surfaces are never gathered in one row
    own = _joined(each, numbered, ["conv_id", "entity_type", "text"]).select("conv_id", "turn", "print", "seq", "n").distinct()
    table = own.groupBy("conv_id", "turn", "print").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "n"))), lambda x: x["n"]).alias("numbers"))
    joined = _joined(rows, table, ["conv_id", "turn", "print"], "left")
    return joined.withColumn("masked", F.when(F.size("spans") > 0, mask.numbered_mask(F.col("text"), F.col("spans"), F.col("numbers"))).otherwise(F.col("text"))).drop("numbers", "print")


def parse_frames(df: DataFrame, col: str) -> DataFrame:
    """Socket frames 42<ack>["message", {user message}] as (prefix, content, contents); all others are dropped."""
    frame = F.regexp_extract(F.col(col), r"^(42\d*)(\[[\s\S]*\])$", 1), F.regexp_extract(F.col(col), r"^(42\d*)(\[[\s\S]*\])$", 2)
    shape = "type string, content string, contents array<struct<type:string,value:string>>"
    out = df.withColumn("prefix", frame[0]).withColumn("args", F.when(F.try_parse_json(frame[1]).isNotNull(), frame[1]))
    out = out.where(F.get_json_object("args", "$[0]") == "message").withColumn("p", F.from_json(F.get_json_object("args", "$[1]"), shape))
    texts = F.filter(F.transform(F.filter("p.contents", lambda c: c["type"] == "text"), lambda c: c["value"]), lambda v: v.rlike(r"\S"))
    out = out.withColumn("content", F.when(F.col("p.content").rlike(r"\S"), F.col("p.content"))).withColumn("contents", F.coalesce(texts, F.array().cast("array<string>")))
    return out.where((F.col("p.type") == "user_message") & (F.col("content").isNotNull() | (F.size("contents") > 0))).drop("args", "p")
