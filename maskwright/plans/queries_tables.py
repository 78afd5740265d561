"""Registered queries: sources, lists, audits, payloads, answers and tagger results over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import udf
from maskwright.functions.joins import grown
from maskwright.operators import aggregate, answers, detect, enrich, filters, mask, payloads
from maskwright.sources import audit
from maskwright.sources import documents as sources
from maskwright.streaming import streams

from . import oracle as O
from .config import MaskConfig
from .memos import SQL as MEMOS
from .memos import memos, quoted
from .queries_spans import hashed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, text, lang FROM documents")
def read_documents(spark, sf_dir):
    """The document scan, with only the columns that are asked for."""
    return sources.read_documents(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, '')) AS text, CAST(count(*) AS INTEGER) AS pages, string_agg(CAST(turn AS VARCHAR) || ':' || CAST(length(coalesce(text, '')) AS VARCHAR), ',' ORDER BY turn, coalesce(text, '')) AS meta FROM conversations GROUP BY conv_id")
def merge_pages(spark, sf_dir):
    """Turns as pages of one document each."""
    out = sources.merge_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.withColumn("meta", F.array_join(F.transform("page_meta", lambda m: F.concat(m["page"].cast("string"), F.lit(":"), m["text_length"].cast("string"))), ",")).drop("page_meta")


@query("SELECT conv_id, turn, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 20 AS needs_ocr FROM conversations")
def needs_ocr(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sources.needs_ocr(F.col("text")).alias("needs_ocr"))


_URL = "url || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.tiff' ELSE '' END"


@query(f"SELECT page_id, CASE WHEN s = 'pdf' THEN 'pdf' WHEN s IN ('png', 'jpg', 'jpeg', 'bmp', 'webp') THEN 'image' ELSE 'unsupported' END AS kind FROM (SELECT page_id, lower(regexp_extract({_URL}, '\\.([^./\\\\]+)$', 1)) AS s FROM pages)")
def file_kind(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, [".PDF", ".jpeg", ".tiff", ""])), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", sources.file_kind(F.concat("url", suffix)).alias("kind"))


_SECRET = "url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=a' || CAST(page_id AS VARCHAR) || '&x=1&api_key=b#top'"


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace({_SECRET}, '([?&](?:token|auth|key|api_key|access_token|sentry_key|session)=)[^&#]*', '\\1REDACTED', 'g') END AS url FROM pages")
def redact_url(spark, sf_dir):
    joint = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    url = F.concat("url", joint, F.lit("token=a"), F.col("page_id").cast("string"), F.lit("&x=1&api_key=b#top"))
    return table(spark, sf_dir, "pages").select("page_id", enrich.redact_url(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(url)).alias("url"))


#: Addresses of four chat services with sending and other paths, picked by page.
_ADDRESSES = [
    "https://claude.ai/api/organizations/o/chat_conversations/{}/completion", "https://claude.ai/api/chat_conversations/{}/title", "https://chatgpt.com/backend-api/conversation?x={}", "https://chatgpt.com/backend-api/conversation/{}/feedback",
    "https://gemini.google.com/_/BardChatUi/data/assistant.lamda.BardFrontendService/StreamGenerate?r={}", "https://api.manus.im/v1/chat/{}", "https://api.manus.im/v1/files/{}/send", "https://example.com/send/{}",
]
_SERVICE_OF = ["a", None, "b", None, "c", "d", None, None]


@query(f"SELECT page_id, CASE page_id % 8 {' '.join(f'WHEN {k} THEN {quoted(s)}' for k, s in enumerate(_SERVICE_OF) if s)} END AS service FROM pages")
def classify_service(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    made = F.element_at(F.array(*[F.concat(F.lit(a.split("{}")[0]), F.col("page_id").cast("string"), F.lit(a.split("{}")[1])) for a in _ADDRESSES]), (F.col("page_id") % 8 + 1).cast("int"))
    return p.select("page_id", payloads.classify_service(made).alias("service"))


_ROUTE = "CASE WHEN regexp_matches(url, '^[a-zA-Z][\\w+.-]*://') THEN regexp_extract(url, '^[a-zA-Z][\\w+.-]*://([^?#]*)', 1) ELSE url END"


@query(f"SELECT DISTINCT 'tag' || CAST(page_id % 3 AS VARCHAR) AS tag, {_ROUTE} AS route FROM pages")
def first_seen_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("tag", F.concat(F.lit("tag"), (F.col("page_id") % 3).cast("string")))
    return streams.first_seen_urls(p).select("tag", "route")


@query("SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END)::BIGINT AS detections FROM events GROUP BY user_id")
def running_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("n", F.when(F.col("event_type") == "error", 2).otherwise(1))
    return streams.running_counts(e, "user_id")


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS \"end\", count(*) AS records, sum(user_id % 5)::BIGINT AS detections FROM events GROUP BY 1, 2")
def audit_windows(spark, sf_dir):
    return streams.audit_windows(table(spark, sf_dir, "events").withColumn("detected_count", F.col("user_id") % 5))


@query("SELECT DISTINCT value FROM (SELECT c_mktsegment AS value FROM customer UNION ALL SELECT s_name FROM supplier) WHERE value IS NOT NULL")
def merge_allowlist(spark, sf_dir):
    return sources.merge_allowlist(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("value")))


_E1 = "SELECT s_name AS value, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'ORGANIZATION' END AS category FROM supplier"
_E2 = "SELECT s_name AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'OTHER' ELSE 'PERSON' END AS category FROM supplier WHERE s_suppkey % 5 < 3"


def _entries(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.col("s_name").alias("value"), F.when(k % 3 != 0, "ORGANIZATION").alias("category")), s.where(k % 5 < 3).select(F.col("s_name").alias("value"), F.when(k % 2 == 0, "OTHER").otherwise("PERSON").alias("category"))


@query(f"SELECT DISTINCT value, coalesce(category, 'OTHER') AS category FROM (SELECT * FROM ({_E1}) UNION ALL SELECT * FROM ({_E2}))")
def upsert_forcelist(spark, sf_dir):
    return sources.upsert_forcelist(*_entries(spark, sf_dir))


@query(f"SELECT value, coalesce(category, 'OTHER') AS category FROM ({_E1}) e WHERE NOT EXISTS (SELECT 1 FROM ({_E2}) r WHERE r.value = e.value AND (r.category = 'PERSON' OR coalesce(e.category, 'OTHER') = r.category))")
def remove_forcelist(spark, sf_dir):
    entries, other = _entries(spark, sf_dir)
    return sources.remove_forcelist(entries, other.withColumn("category", F.when(F.col("category") != "PERSON", F.col("category"))))


@query(f"SELECT value, category FROM ({_E2}) e WHERE NOT EXISTS (SELECT 1 FROM ({_E1}) p WHERE p.value = e.value AND coalesce(p.category, 'OTHER') = e.category)")
def new_entries(spark, sf_dir):
    before, now = _entries(spark, sf_dir)
    return aggregate.new_entries(now, before)


def _audits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 4).cast("int")
    when = F.when(F.col("o_orderkey") % 11 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    summary = F.when(n > 0, F.create_map(F.when(F.col("o_orderkey") % 3 == 0, "PERSON").otherwise("URL"), n)).otherwise(F.create_map().cast("map<string,int>"))
    return o.select(F.col("o_orderkey").alias("append_seq"), (F.col("o_orderkey") % 5 != 0).alias("filter_enabled"), n.alias("detected_count"), summary.alias("entity_summary"), when.alias("created_at"))


_AUD = "SELECT o_orderkey AS append_seq, o_orderkey % 5 <> 0 AS filter_enabled, CAST(o_orderkey % 4 AS INTEGER) AS detected_count, o_orderkey % 3 = 0 AND o_orderkey % 4 > 0 AS person, CASE WHEN o_orderkey % 11 = 0 THEN 'not a time' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS created_at FROM orders"


@query(f"SELECT append_seq, created_at, detected_count FROM ({_AUD}) WHERE TRY_CAST(created_at AS TIMESTAMP) >= TIMESTAMP '1996-01-01' AND person AND filter_enabled AND detected_count > 0 ORDER BY append_seq DESC LIMIT 100")
def list_audits(spark, sf_dir):
    """The newest 100 records that pass all filters."""
    return audit.list_audits(_audits(spark, sf_dir), 100, "1996-01-01", "PERSON", "masked").select("append_seq", "created_at", "detected_count")


@query(f"SELECT append_seq, created_at FROM ({_AUD}) WHERE filter_enabled AND detected_count = 0")
def allowed_audits(spark, sf_dir):
    return audit.filter_audits(_audits(spark, sf_dir), action="allowed").select("append_seq", "created_at")


_TAGS = ["B-PER", "I-PER", "E-PER", "O", "B-LOC", "I-ORG", "B-MISC"]
_NER = "SELECT l_orderkey AS doc_id, l_linenumber AS idx, ['B-PER','I-PER','E-PER','O','B-LOC','I-ORG','B-MISC'][CAST(l_suppkey % 7 + 1 AS INTEGER)] AS tag, l_discount AS score, l_linenumber * 10 AS s, l_linenumber * 10 + CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE 5 END AS e FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_discount) AS l_discount FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_BIO = f"""SELECT doc_id, type AS entity_group, arg_min(s, idx) AS start, arg_max(e, idx) AS "end", avg(score) AS score FROM (
SELECT *, sum(CASE WHEN prefix = 'B' OR prefix = '' OR lagged IS DISTINCT FROM type THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM (
SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY idx) AS lagged FROM (SELECT *, regexp_extract(tag, '^([BIE])-(.+)$', 1) AS prefix, regexp_extract(tag, '^([BIE])-(.+)$', 2) AS type FROM ({_NER})) WHERE prefix = '' OR e > s)) WHERE prefix <> '' GROUP BY doc_id, type, island"""


def _ner(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_discount")])
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("l_suppkey") % 7 + 1).cast("int"))
    at = F.col("l_linenumber") * 10
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), tag.alias("tag"), F.col("l_discount").alias("score"), at.alias("start"), (at + F.when(F.col("l_partkey") % 13 == 0, 0).otherwise(5)).alias("end"))


@query(f"SELECT doc_id, entity_group, start, \"end\", round(score, 6) AS score FROM ({_BIO})")
def bio_spans(spark, sf_dir):
    """Tagged tokens merged to spans."""
    return detect.bio_spans(_ner(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, 'PROPER_NOUN_' || CASE entity_group WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' ELSE 'ORG' END AS entity_type, start, \"end\" FROM ({_BIO}) WHERE entity_group <> 'MISC'")
def ner_labels(spark, sf_dir):
    return detect.map_ner_labels(detect.bio_spans(_ner(spark, sf_dir))).select("doc_id", "entity_type", "start", "end")


@query("SELECT p_partkey AS id, CAST(i - 1 AS INTEGER) AS idx, CAST(CASE WHEN i = 1 THEN 0 WHEN i = n + 2 THEN total ELSE b END AS INTEGER) AS start, CAST(CASE WHEN i = 1 THEN 0 WHEN i = n + 2 THEN total ELSE b + len(w[i - 1]) END AS INTEGER) AS \"end\" FROM (SELECT p_partkey, w, n, total, i, coalesce(list_sum(list_transform(w[1:i - 2], lambda x: length(x) + 1)), 0) AS b FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, len(string_split(p_name, ' ')) AS n, length(p_name) AS total, unnest(range(1, len(string_split(p_name, ' ')) + 3)) AS i FROM part))")
def piece_offsets(spark, sf_dir):
    """Offsets of word pieces in part names."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(detect.piece_offsets(F.col("p_name"), F.split("p_name", " "))).alias("idx", "o")).select("id", "idx", "o.start", "o.end")


_CT = O.matches("(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations WHERE role = 'user')", [("WORD", r"\b[A-Z]\w{7,}\b")])
_CT = O.spliced("SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations", O.last_of_equal(O.numbered(_CT)), O.TAG)


@query(f"SELECT c.conv_id, c.turn, c.role, masked FROM ({_CT}) m JOIN conversations c ON c.conv_id * 100000 + c.turn = m.doc_id")
def mask_conversation_turns(spark, sf_dir):
    """User turns masked, numbered by turn."""
    spans = lambda t: S.regex_spans(t, "WORD", r"\b[A-Z]\w{7,}\b", "standalone")
    return payloads.mask_conversations(table(spark, sf_dir, "conversations"), spans).select("conv_id", "turn", "role", "masked")


_CW = O.matches("(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations WHERE role = 'user')", [("WORD", r"\b[A-Z][0-9A-Za-z_]{7,}\b")])
_CN = f"SELECT *, dense_rank() OVER (PARTITION BY doc_id // 100000, entity_type ORDER BY first) AS n FROM (SELECT *, min({{'t': doc_id, 's': start}}) OVER (PARTITION BY doc_id // 100000, entity_type, text) AS first FROM ({_CW}))"


@query(f"SELECT doc_id // 100000 AS conv_id, doc_id % 100000 AS turn, masked FROM ({O.spliced('SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations', _CN, O.TAG)})")
def mask_conversations(spark, sf_dir):
    """User turns masked, numbers running through a conversation."""
    spans = lambda t: S.regex_spans(t, "WORD", r"\b[A-Z][0-9A-Za-z_]{7,}\b", "standalone")
    return payloads.mask_conversations(table(spark, sf_dir, "conversations"), spans, scope="conversation").select("conv_id", "turn", "masked")


def bodies(spark, sf_dir, service: str) -> DataFrame:
    """(id, body, text): JSON bodies of a service made from memos."""
    m = memos(spark, sf_dir)
    text = F.col("text")
    note = F.lit("note").alias("content")
    messages = {
        "openai": F.struct(text.alias("input"), F.lit("be kind").alias("system"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"), F.lit(3).alias("n")),
        "a": F.struct(text.alias("prompt"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content")), F.struct(F.lit("assistant").alias("role"), note)).alias("messages"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")),
        "b": F.struct(F.array(F.struct(F.struct(F.lit("user").alias("role")).alias("author"), F.struct(F.array(text, F.lit(" ")).alias("parts")).alias("content"))).alias("messages"), F.lit("x").alias("model")),
        "c": F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))).alias("contents"), F.to_json(F.array(F.array(text))).alias("f.req")),
        "d": F.struct(text.alias("input"), F.lit("ask").alias("query"), F.array(F.struct(F.lit("text").alias("type"), text.alias("value"))).alias("contents"), F.array(F.struct(F.lit("user").alias("role"), note)).alias("messages")),
    }
    return m.select(F.col("doc_id").alias("id"), F.to_json(messages[service]).alias("body"), "text")


_MAIL = f"({O.spliced(MEMOS, O.last_of_equal(O.numbered(O.resolved(O.matches(f'({MEMOS})', O.presets(['EMAIL_ADDRESS']))))), O.TAG)})"
_DETECTED = f"SELECT * FROM ({O.resolved(O.matches(f'({MEMOS})', O.presets()))}) WHERE text NOT IN ({', '.join(map(quoted, MaskConfig().blocklist))})"
_ALL = f"({O.spliced(MEMOS, O.last_of_equal(O.numbered(_DETECTED)), O.TAG)})"
_EXPECT = {"openai": ["m", "'be kind'", "m"], "a": ["m", "m", "m"], "b": ["m"], "c": ["m", "t"], "d": ["m", "'ask'", "m", "'note'"]}


def _payload(service: str) -> None:
    # all categories, but for one service addresses only
    cfg = MaskConfig(disabled=[c for c in dict.fromkeys(p[0] for p in detect.PRESETS) if c != "EMAIL_ADDRESS"] if service == "openai" else [])
    listed = ", ".join(x.replace("m", "masked") if x == "m" else x for x in _EXPECT[service] if x != "t")

    @query(f"SELECT doc_id AS id, array_to_string([{listed}], chr(10)) AS texts, {'true' if service == 'c' else 'false'} AS unreplaced FROM {_MAIL if service == 'openai' else _ALL}")
    def run(spark, sf_dir):
        out = payloads.mask_payload(bodies(spark, sf_dir, service), "body", service, cfg)
        again = payloads.extract_inputs(out.select("id", "masked_body", "unreplaced"), "masked_body", service)
        texts = F.slice("texts", 1, len([x for x in _EXPECT[service] if x != "t"]))
        return again.select("id", F.array_join(texts, "\n").alias("texts"), "unreplaced")

    run.__name__ = f"payload_{service}"
    QUERIES[run.__name__], ORACLE[run.__name__] = QUERIES.pop("run"), ORACLE.pop("run")


for _service in _EXPECT:
    _payload(_service)


@query(f"SELECT doc_id AS id, text || chr(10) || text AS segments, 'x' || chr(10) || text AS normal FROM ({MEMOS})")
def text_segments(spark, sf_dir):
    """Texts of request bodies, and the joined text parts of answers."""
    b = bodies(spark, sf_dir, "openai")
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.lit(" x").alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    return b.select("id", F.array_join(payloads.text_segments(F.col("body")), "\n").alias("segments"), payloads.normalized_text(answer).alias("normal"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '42' ELSE '427' END AS prefix, CASE WHEN o_orderkey % 4 = 0 THEN 'hello ' || CAST(o_orderkey AS VARCHAR) END AS content, CASE WHEN o_orderkey % 4 = 1 THEN 'part ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS contents FROM orders WHERE o_orderkey % 4 < 2")
def parse_frames(spark, sf_dir):
    """Socket frames with user messages; other events and broken frames go."""
    k = F.col("o_orderkey").cast("string")
    frames = [
        F.concat(F.lit('42["message",{"type":"user_message","content":"hello '), k, F.lit('"},1]')), F.concat(F.lit('427["message",{"type":"user_message","contents":[{"type":"text","value":"part '), k, F.lit('"},{"type":"file","value":"f"}]}]')),
        F.concat(F.lit('42["status",{"type":"user_message","content":"'), k, F.lit('"}]')), F.concat(F.lit('42["message",{"type":"user_message"'), k),
    ]
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*frames), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("frame"))
    return payloads.parse_frames(df, "frame").select("id", "prefix", "content", F.array_join("contents", ",").alias("contents"))


def _answers(spark, sf_dir) -> DataFrame:
    """(doc_id, text, answer): answers of several shapes to each memo."""
    c = F.col("o_custkey").cast("string")
    ents = F.concat(F.lit('{"entities":[{"text":"user'), c, F.lit('@example.com","entity_type":"email_address"},{"text":" の ","entity_type":"PERSON"},{"text":"CEO","entity_type":"PERSON"},{"text":" ","entity_type":"PERSON"},{"text":"担当","entity_type":"company"},{"text":5}]}'))
    shapes = [ents, F.concat(F.lit("<think>let {me} see</think>\n```json\n"), ents, F.lit("\n```")), F.concat(F.lit("Here it is: "), ents, F.lit(" done")), F.lit('{"entities":[]}'), F.lit("no json at all"), F.lit("[1,2]"), F.lit("<think>never closed {"), F.lit('{"entities":7}')]
    o = table(spark, sf_dir, "orders")
    return memos(spark, sf_dir).join(grown(o.select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.array(*shapes), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("answer"))), "doc_id")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 8 < 3 THEN 'ok_entities' WHEN o_orderkey % 8 = 3 THEN 'ok_empty' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 8 < 3 THEN 4 WHEN o_orderkey % 8 = 3 THEN 0 END AS n FROM orders")
def llm_answers(spark, sf_dir):
    """Status of answers with fences, reasoning, prose, wrong shapes and none."""
    e = _answers(spark, sf_dir).withColumn("e", answers.parse_llm_detect(F.col("answer")))
    return e.select("doc_id", answers.llm_status(F.col("e")).alias("status"), F.when(F.col("e").isNotNull(), F.size("e")).alias("n"))


def _llm_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = _answers(spark, sf_dir)
    e = a.select("doc_id", F.posexplode_outer(answers.parse_llm_detect(F.col("answer"))).alias("idx", "e")).where(F.col("e").isNotNull()).select("doc_id", "idx", "e.text", "e.entity_type")
    return aggregate.llm_rows(filters.llm_denylist(e), a.select("doc_id", "text")), a


_LLM = """SELECT doc_id, o.k AS ord, value, label, category, len(string_split(text, value)) - 1 AS "count", severity, text FROM (SELECT m.doc_id, m.text, o_custkey FROM ({memos}) m JOIN orders ON o_orderkey = m.doc_id WHERE o_orderkey % 8 < 3) d,
LATERAL (VALUES (0, 'user' || CAST(o_custkey AS VARCHAR) || '@example.com', 'EMAIL_ADDRESS', 'OTHER', 'medium'), (1, 'の', 'PERSON', 'PERSON', 'critical'), (4, '担当', 'COMPANY', 'ORGANIZATION', 'critical')) o(k, value, label, category, severity) WHERE contains(text, value)""".replace("{memos}", MEMOS)


@query(f"SELECT doc_id, value, label, category, CAST(\"count\" AS INTEGER) AS \"count\", severity, '<' || label || '_1>' AS placeholder FROM ({_LLM})")
def llm_rows(spark, sf_dir):
    """All places of the values that answers name, after the denylist."""
    return _llm_rows(spark, sf_dir)[0].select("doc_id", "value", "label", "category", "count", "severity", "placeholder")


_MEM = MEMOS
_REG = O.resolved(O.matches(f"({_MEM})", O.presets(["EMAIL_ADDRESS", "AGE"])))


@query(f"SELECT doc_id, value, label, CAST(0 AS INTEGER) AS source FROM ({_LLM}) UNION ALL SELECT DISTINCT r.doc_id, r.text, r.entity_type, CAST(1 AS INTEGER) FROM ({_REG}) r WHERE NOT EXISTS (SELECT 1 FROM ({_LLM}) l WHERE l.doc_id = r.doc_id AND l.value = r.text)")
def merge_llm(spark, sf_dir):
    """Answers' rows first; rows of the presets for other surfaces stay."""
    rows, a = _llm_rows(spark, sf_dir)
    off = [c for c in dict.fromkeys(p[0] for p in detect.PRESETS) if c not in ("EMAIL_ADDRESS", "AGE")]
    own = aggregate.aggregate_entities(enrich.detections(mask.sanitize(a.select("doc_id", "text"), MaskConfig(disabled=off))))
    return aggregate.merge_llm(own, rows).select("doc_id", "value", "label", "source")


def _rewrites(spark, sf_dir) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit('{"rewritten_text":"x","replacements":[{"original":"user'), c, F.lit('@example.com","replacement":"<Email_1>","entity_type":"EMAIL_ADDRESS"},{"original":"user","entity_type":"person"},{"original":" and ","replacement":"&","entity_type":"q"},{"original":"user","replacement":"<z>"}]}')).alias("answer"))
    return memos(spark, sf_dir).join(grown(o), "doc_id").withColumn("r", answers.parse_llm_replace(F.col("answer"))["replacements"])


_RW = f"""SELECT doc_id, seq, entity_type, start, "end", text FROM (
SELECT m.doc_id, 0 + i AS seq, '<email_1>' AS entity_type, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(v) AS INTEGER) AS start, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + i * length(v) AS INTEGER) AS "end", v AS text FROM (SELECT doc_id, v, string_split(text, v) AS p, unnest(range(1, len(string_split(text, v)))) AS i FROM (SELECT m.doc_id, m.text, 'user' || CAST(o_custkey AS VARCHAR) || '@example.com' AS v FROM ({MEMOS}) m JOIN orders ON o_orderkey = m.doc_id)) m
UNION ALL SELECT * FROM ({O.literals(f'({MEMOS})', [('user', '<name_1>'), ('and', '<masked_1>')])}))"""
_RWD = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, seq) AS rn FROM ({_RW})),
r AS (SELECT doc_id, rn, seq, entity_type, start, "end", text, "end" AS last, true AS kept FROM s WHERE rn = 1
UNION ALL SELECT s.doc_id, s.rn, s.seq, s.entity_type, s.start, s."end", s.text, CASE WHEN s.start >= r.last THEN s."end" ELSE r.last END, s.start >= r.last FROM r JOIN s ON s.doc_id = r.doc_id AND s.rn = r.rn + 1)
SELECT * FROM r WHERE kept"""


@query(f"SELECT doc_id, masked AS rewritten FROM ({O.spliced(MEMOS, _RWD, 'entity_type')})")
def rewrite_with_tags(spark, sf_dir):
    """Answers' replacements as unique tags, longest first."""
    return mask.rewrite_with_tags(_rewrites(spark, sf_dir), "text", "r").select("doc_id", F.col("rewritten.rewritten_text").alias("rewritten"))


@query(f"SELECT doc_id, value, label, strpos(text, value) - 1 AS start FROM (SELECT m.doc_id, m.text, v.value, v.label FROM ({MEMOS}) m JOIN orders ON o_orderkey = m.doc_id, LATERAL (VALUES ('user' || CAST(o_custkey AS VARCHAR) || '@example.com', 'EMAIL_ADDRESS'), ('user', 'PERSON'), (' and ', 'Q'), ('user', 'SENSITIVE_FACT')) v(value, label)) WHERE contains(text, value)")
def rows_from_replacements(spark, sf_dir):
    rows = answers.rows_from_replacements(_rewrites(spark, sf_dir), replacements_col="r")
    return rows.select("doc_id", "value", "label", F.col("positions")[0]["start"].cast("long").alias("start"))


@query(f"SELECT doc_id, length(text) > 6 AND regexp_matches(text, 'ます|ません|ください|いたします|致します|願い|注意|確認|ご了承|申し訳|ありがと|よろしく|とおり|ように|ような|については|ところ|ため|こと|もの|それ|これ|あれ') AS phrase FROM ({MEMOS})")
def person_phrases(spark, sf_dir):
    from maskwright.functions import labels

    return memos(spark, sf_dir).select("doc_id", labels.is_false_positive_person(F.col("text")).alias("phrase"))


@query(f"SELECT entity_type, {O.severity('entity_type')} AS severity, count(*) AS n FROM ({_DETECTED}) GROUP BY 1, 2")
def detect_table_function(spark, sf_dir):
    """The table function over memos, as rows by label."""
    udf.register(spark)
    memos(spark, sf_dir).createOrReplaceTempView("__memos")
    return spark.sql("SELECT d.entity_type, severity_for(d.entity_type) AS severity, count(*) AS n FROM __memos m, LATERAL detect(m.text) d GROUP BY 1, 2")


_BY_HASH = O.spliced(MEMOS, O.last_of_equal(_DETECTED), O.HASH)


_BY_PART = O.spliced(MEMOS, _DETECTED, O.PARTIAL, "seq")
_BY_FAKE = O.spliced(MEMOS, hashed(O.greedy(O.last_of_equal(_DETECTED))), O.surrogate("entity_type", "text", "h"))


@query(f"SELECT t.doc_id, CASE t.doc_id % 4 WHEN 0 THEN t.masked WHEN 1 THEN h.masked WHEN 2 THEN p.masked ELSE s.masked END AS masked FROM {_ALL} t JOIN ({_BY_HASH}) h USING (doc_id) JOIN ({_BY_PART}) p USING (doc_id) JOIN ({_BY_FAKE}) s USING (doc_id)")
def sanitize_text_function(spark, sf_dir):
    """Masking by the SQL function, with each of the four strategies."""
    udf.register(spark)
    memos(spark, sf_dir).createOrReplaceTempView("__memos")
    return spark.sql("SELECT doc_id, sanitize_text(text, element_at(array('tag', 'hash', 'partial', 'surrogate'), CAST(doc_id % 4 AS INT) + 1)) AS masked FROM __memos")


class _Handles:
    """A detector that is not part of the library: customers' handles, found by Python over Arrow batches."""

    name = "handles"

    def spans(self, text):
        def run(texts: pa.Array) -> pa.Array:
            found = [[{"entity_type": "HANDLE", "start": m.start(), "end": m.end(), "score": 0.5, "text": m[0], "seq": 0, "source": "handles"} for m in re.finditer("user[0-9]+", t or "")] for t in texts.to_pylist()]
            return pa.array(found, pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string()), ("seq", pa.int32()), ("source", pa.string())])))

        return F.arrow_udf(run, f"array<{S.SPAN}>")(text)


_HANDLES = O.matches(f"({MEMOS})", [("HANDLE", "user[0-9]+")])


@query(f"SELECT doc_id, masked FROM ({O.spliced(MEMOS, O.last_of_equal(O.numbered(_HANDLES)), O.TAG)})")
def detector_plugin(spark, sf_dir):
    """A chain of a detector given by the user, by its name, for every language."""
    cfg = MaskConfig(presets=False, chains={lang: ["handles"] for lang in ("ja", "en", "mixed")})
    return mask.sanitize(memos(spark, sf_dir), cfg, detectors=[_Handles()]).select("doc_id", F.col("sanitized_text").alias("masked"))
