import json
import math
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from maskwright.functions import arrow
from maskwright.functions import spans as S
from maskwright.operators import detect, filters, mask, payloads
from maskwright.plans.config import MaskConfig
from maskwright.sources import audit, documents
from maskwright.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that are quick enough for every test run; all others are compared by the driver.
QUICK = ["sanitize_documents", "language_memos", "merge_pages", "needs_ocr", "file_kind", "redact_url", "classify_service", "first_seen_urls", "running_counts", "audit_windows", "merge_allowlist", "upsert_forcelist", "remove_forcelist", "new_entries", "list_audits", "allowed_audits", "bio_spans", "ner_labels", "piece_offsets", "mask_conversations", "text_segments", "parse_frames", "llm_answers", "rows_from_replacements", "rewrite_with_tags", "literal_force_list", "token_spans", "mask_stream", "list_updates", "audit_stream", "audit_table", "read_vectors"]
MAIL = MaskConfig(disabled=[c for c in dict.fromkeys(p[0] for p in __import__("maskwright.functions.patterns", fromlist=["PRESETS"]).PRESETS) if c != "EMAIL_ADDRESS"])


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    ref = duck.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in ref.description]
    want = [dict(zip(cols, r)) for r in ref.fetchall()]
    assert sorted(got.columns) == sorted(cols)
    cols = sorted(cols)
    assert sorted(tuple(norm(v) for v in r) for r in got[cols].itertuples(index=False, name=None)) == sorted(tuple(norm(r[c]) for c in cols) for r in want)


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


@pytest.fixture
def arrivals(spark, tmp_path):
    rows = [(k, f"mail u{k % 7}@example.com", f"s{k % 3}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, session string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), df, tmp_path


def ran(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_mask_stream_equals_batch(spark, arrivals):
    stream, batch, tmp = arrivals
    out = streams.mask_stream(stream, MAIL).select("doc_id", "sanitized_text")
    ran(out.writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "cp")).trigger(availableNow=True).start())
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.read.parquet(str(tmp / "out"))) == key(mask.sanitize(batch, MAIL).select("doc_id", "sanitized_text"))


def test_audit_stream_and_queries(spark, arrivals):
    stream, batch, tmp = arrivals
    ran(streams.audit_stream(streams.mask_stream(stream, MAIL), str(tmp / "audit"), str(tmp / "cp2")))
    rows = audit.read_audit(spark, str(tmp / "audit"))
    assert rows.count() == 40 and rows.agg(F.sum("detected_count")).first()[0] == 40
    assert audit.list_audits(rows, 5, since="2020-01-01", entity_type="EMAIL_ADDRESS", action="masked").count() == 5
    assert audit.filter_audits(rows, action="odd").count() == 0 and audit.filter_audits(rows, action="allowed").count() == 0
    with pytest.raises(ValueError):
        audit.list_audits(rows, 0)


def test_running_counts_stream(spark, arrivals):
    stream, batch, tmp = arrivals
    counts = streams.running_counts(stream.withColumn("n", F.lit(2)), "session")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp / "cp3")).trigger(availableNow=True).start()
    ran(q)
    assert {r["session"]: r["detections"] for r in spark.table("counts").collect()} == {"s0": 28, "s1": 26, "s2": 26}


def test_a_batch_written_again_adds_nothing(spark, arrivals, monkeypatch):
    """The order of a stream's records is total, and a batch that fails behind its write is not counted twice."""
    stream, batch, tmp = arrivals
    at = str(tmp / "audit2")
    rows = lambda: audit.list_audits(audit.read_audit(spark, at), 10_000).collect()
    masked, build, tries = streams.mask_stream(stream, MAIL), audit.audit_records, []

    def records(docs, *args, **kwargs):
        tries.append(1)
        if len(tries) == 2:
            build(docs).write.mode("overwrite").format("json").partitionBy("day").save(f"{at}/batch=1")
            raise RuntimeError("lost behind the write")
        return build(docs, *args, **kwargs)

    monkeypatch.setattr(audit, "audit_records", records)
    with pytest.raises(Exception, match="lost behind the write"):
        ran(streams.audit_stream(masked, at, str(tmp / "cp5")))
    ran(streams.audit_stream(masked, at, str(tmp / "cp5")))
    got = rows()
    keys = [(r["append_seq"], r["batch"], r["append_row"]) for r in got]
    assert len(got) == 40 and len(set(keys)) == 40 and keys == sorted(keys, reverse=True) and len({r["audit_id"] for r in got}) == 40
    assert [r["batch"] for r in got] == sorted((r["batch"] for r in got), reverse=True)


def test_lists_on_rows_of_any_id(spark, tmp_path):
    """Rows that share an id, or have none, are masked each by its own text."""
    rows = [(1, "a secretword here"), (1, "this third is here"), (None, "a secretword too"), (None, None), (2, "third secretword third"), (2, "nothing"), (1, "a secretword here")]
    spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    entries = spark.createDataFrame([("secretword", "OTHER"), ("third", "PERSON")], "value string, category string")
    got = []
    ran(streams.with_lists(stream, lambda: entries, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), MAIL))
    a, b = "<USER_DEFINED_OTHER_1>", "<USER_DEFINED_PERSON_1>"
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["sanitized_text"] or "") for r in got) == sorted([(1, rows[0][1], f"a {a} here"), (1, rows[0][1], f"a {a} here"), (1, rows[1][1], f"this {b} is here"), (0, rows[2][1], f"a {a} too"), (0, "", ""), (2, rows[4][1], f"{b} {a} {b}"), (2, "nothing", "nothing")])
    assert set(got[0].asDict()) == {"doc_id", "text", "spans", "sanitized_text"}


def test_lists_read_anew(spark, arrivals):
    stream, batch, tmp = arrivals
    got = []
    ran(streams.with_lists(stream.select("doc_id", "text"), lambda: spark.createDataFrame([("mail", "OTHER")], "value string, category string"), lambda df, n: got.extend(df.select("sanitized_text").collect()), str(tmp / "cp4"), MAIL))
    assert len(got) == 40 and all(r[0] == "<USER_DEFINED_OTHER_1> <EMAIL_ADDRESS_1>" for r in got)


def test_vectors_and_lists(spark, tmp_path):
    vector = {"label_groups": ["EMAIL_ADDRESS"], "cases": [{"name": "one", "input": "a@b.example", "expected": [{"label": "EMAIL_ADDRESS"}]}, {"name": "two", "input": "none"}]}
    (tmp_path / "v.json").write_text(json.dumps(vector))
    rows = documents.read_vectors(spark, str(tmp_path / "v.json"))
    assert rows.count() == 2 and rows.where("mode = 'detection'").count() == 2
    found = mask.sanitize(rows.withColumnsRenamed({"input": "text", "name": "doc_id"}), MAIL)
    assert found.where("doc_id = 'one' and exists(spans, s -> s.entity_type = expected[0].label)").count() == 1
    values = spark.createDataFrame([("a",), ("b",)], "value string")
    documents.export_allowlist(values, str(tmp_path / "list"))
    assert documents.merge_allowlist(documents.import_allowlist(spark, str(tmp_path / "list")), spark.createDataFrame([("b",), (None,)], "value string")).count() == 2


def test_payload_keeps_other_keys(spark):
    body = {"messages": [{"role": "system", "content": [{"type": "text", "content": "x a@b.example"}, {"type": "image", "u": 1}]}], "system": ["a@b.example"], "temperature": 0.5}
    out = payloads.mask_payload(spark.createDataFrame([(json.dumps(body),), ("not json",), (None,)], "body string"), "body", "openai", MAIL).collect()
    masked = json.loads(out[0]["masked_body"])
    assert masked["messages"][0]["content"][0]["content"] == "x <EMAIL_ADDRESS_1>" and masked["system"] == ["a@b.example"] and masked["temperature"] == 0.5
    assert out[1]["masked_body"] == "not json" and out[2]["masked_body"] is None and out[1]["texts"] == []


def test_empty_and_odd_columns(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, spans string")
    assert mask.sanitize(empty.drop("spans")).count() == 0
    extra = spark.createDataFrame([(1, "a@b.example", "x")], "doc_id int, text string, start string")
    assert mask.sanitize(extra, MAIL).select("start", F.size("spans")).first()[1] == 1
    assert S.none() is not None


def model_occurrences(text, entries):
    out = []
    for k, (value, _) in enumerate(entries):
        at = (text or "").find(value) if value else -1
        while at >= 0:
            out.append((value, at))
            at = text.find(value, at + len(value))
    return sorted(out)


@pytest.mark.parametrize("rows, parts", [(100_000, 8), (2, 8), (2, 1)])
def test_list_occurrences(spark, monkeypatch, rows, parts):
    """By one automaton, by several and by grams alike: overlaps between values, repeats, short values, other scripts."""
    monkeypatch.setattr(detect, "LIST_ROWS", rows)
    monkeypatch.setattr(detect, "LIST_PARTS", parts)
    entries = [("aa", "PERSON"), ("a", None), ("aab", "x"), ("漢字", "other"), ("😀😀", "PERSON"), ("long value here", "PERSON"), ("", "PERSON"), ("a.b", "PERSON")]
    texts = ["aaaaab aab", "漢字漢字 a.b axb 😀😀😀", "a long value here, long value here", "", None, "nothing", "x\naa\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    listed = spark.createDataFrame(entries, "value string, category string").coalesce(1)
    got = {r["doc_id"]: sorted((s["text"], s["start"]) for s in r["spans"]) for r in detect.literal_spans(docs, listed).collect()}
    want = {k: model_occurrences(t, entries) for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}
    spans = {s["text"]: s["entity_type"] for r in detect.literal_spans(docs, listed).collect() for s in r["spans"]}
    assert spans["aa"] == "USER_DEFINED_PERSON" and spans["a"] == spans["aab"] == "USER_DEFINED_OTHER"
    plan = detect.literal_spans(docs, listed)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert detect.literal_spans(docs, listed.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [8, 0])
def test_a_long_list_with_one_prefix(spark, monkeypatch, parts):
    """Values that all begin alike don't bring every text together with the whole list."""
    monkeypatch.setattr(detect, "LIST_PARTS", parts)
    listed = spark.range(50_000).select(F.format_string("EMP-%07d", F.col("id") * 7).alias("value"), F.lit("PERSON").alias("category"))
    docs = spark.range(2_000).select((F.col("id") % 3).alias("doc_id"), F.format_string("staff EMP-%07d and EMP-%07d, EMP-", F.col("id") * 5, F.col("id") * 11).alias("text")).withColumn("found", F.lit("x"))
    rows = detect.with_occurrences(docs, listed)
    want = sum((k * 5 % 7 == 0) + (k * 11 % 7 == 0) for k in range(2_000))
    assert rows.count() == 2_000 and rows.select(F.explode("found")).count() == want
    if not parts:
        met = rows._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in met and "Cartesian" not in met


def test_batches_are_taken_up_in_slices(spark):
    """A batch of many long texts isn't turned into Python objects at once; rows and results stay whole and in place."""
    docs = spark.range(0, 3_000, numPartitions=1).select("id", F.concat(F.format_string("v%d ", "id"), F.repeat(F.lit("x"), F.when(F.col("id") == 7, 2_000_000).otherwise(2_000))).alias("text"))
    together = arrow.appended(docs, ["text"], lambda: lambda t: pa.array([len(t)] * len(t), pa.int32()), "n", "int").select("id", "n").collect()
    assert [r["id"] for r in together] == list(range(3_000)) and together[7]["n"] == 1
    assert max(r["n"] for r in together) <= 600
    listed = spark.range(3_000).select(F.format_string("v%d ", "id").alias("value"), F.lit("PERSON").alias("category"))
    rows = detect.with_occurrences(docs, listed).selectExpr("id", "transform(found, f -> f.text) AS found").collect()
    assert [r["id"] for r in rows] == list(range(3_000)) and all(r["found"] == [f"v{r['id']} "] for r in rows)


def test_several_automata_over_slices(spark, monkeypatch):
    monkeypatch.setattr(detect, "LIST_ROWS", 1_000)
    docs = spark.range(0, 2_000, numPartitions=1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.format_string("v%d w%d ", "id", "id"), F.repeat(F.lit("x"), 2_000))).alias("text"))
    listed = spark.range(4_000).select(F.format_string("%s%d ", F.when(F.col("id") < 2_000, "w").otherwise("v"), F.col("id") % 2_000).alias("value"), F.lit("PERSON").alias("category"))
    rows = detect.with_occurrences(docs, listed).selectExpr("id", "transform(found, f -> (f.k, f.start, f.end, f.text)) AS found").collect()
    n = lambda k: len(str(k)) + 2
    want = lambda k: [(k, n(k), 2 * n(k), f"w{k} "), (2_000 + k, 0, n(k), f"v{k} ")] if k % 5 else []
    assert all([tuple(x) for x in r["found"]] == want(r["id"]) for r in rows) and len(rows) == 2_000


def test_piece_offsets_in_long_texts(spark):
    import random

    def plain(text, pieces):
        out, at = [(0, 0)], 0
        for p in pieces:
            while at < len(text) and text[at] in " \t\n\x0b\f\r":
                at += 1
            n = len(p.removeprefix("##"))
            out.append((at, at + n))
            at += n
        return [*out, (at, at)]

    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ab😀  \n") for _ in range(rnd.randint(0, 40))), [rnd.choice(["", "##"]) + "a" * rnd.randint(0, 5) for _ in range(rnd.randint(0, 14))]) for i in range(150)]
    rows += [(1000, " abc" * 20_000, ["abc"] * 20_000), (1001, "", []), (1002, "   ", ["a"])]
    df = spark.createDataFrame(rows, "id int, t string, p array<string>")
    got = {r[0]: [tuple(x) for x in r[1]] for r in df.select("id", detect.piece_offsets(F.col("t"), F.col("p"))).collect()}
    assert got == {i: plain(t, p) for i, t, p in rows}


def test_many_replacements(spark):
    """Tags numbered within their base by first original, overlaps longest first, thousands of replacements at once."""
    n = 4_000
    reps = [{"original": f" w{k % 3_000}x ", "replacement": f"<{'bcdefgh'[k % 7]}_3>" if k % 2 else None, "entity_type": "PERSON"} for k in range(n)] + [{"original": "w1", "replacement": "<z>"}, {"original": " ", "replacement": "y"}, {"original": None}]
    kind = "array<struct<original:string,replacement:string,entity_type:string>>"
    df = spark.createDataFrame([(1, " ".join(f"w{k}x" for k in range(3_000)) + " w1", reps), (2, "none", []), (3, None, reps), (4, "aaa xaaa", [{"original": "xa"}, {"original": "aa"}])], f"id int, text string, replacements {kind}")
    got = {r["id"]: r["rewritten"] for r in mask.rewrite_with_tags(df).collect()}
    counts, tags = {}, []
    for k in range(3_000):
        base = "bcdefgh"[k % 7] if k % 2 else "name"
        counts[base] = counts.get(base, 0) + 1
        tags.append(f"<{base}_{counts[base]}>")
    assert got[1]["rewritten_text"] == " ".join(tags) + " <z_1>" and len(got[1]["replacements"]) == 3_001
    assert got[2]["rewritten_text"] == "none" and got[3] is None and got[4]["rewritten_text"] == "<masked_2>a <masked_1>aa"


def test_payload_bodies_stay_to_the_character(spark):
    """Spacing, numbers, escapes and key order around a masked text stay; keys named twice count once."""
    rows = [
        (1, '{ "input" :\t"mail a@b.example \\u00e9\\n" , "n": 1.50e3, "x": "caf\\u00e9", "messages": [ {"role":"user","content":"none"} ] }', '{ "input" :\t"mail <EMAIL_ADDRESS_1> é\\n" , "n": 1.50e3, "x": "caf\\u00e9", "messages": [ {"role":"user","content":"none"} ] }'),
        (2, '{"input": "😀 a@b.example \\"q\\"", "system": "c@d.example"}', '{"input": "😀 <EMAIL_ADDRESS_1> \\"q\\"", "system": "<EMAIL_ADDRESS_1>"}'),
        (3, '{"input": "a@b.example", "k": 1, "input": "c@d.example"}', '{"input": "<EMAIL_ADDRESS_1>", "k": 1}'),
        (4, '{"messages": [{"content": [{"type": "text", "text": null, "content": "a@b.example"}]}]}', '{"messages": [{"content": [{"type": "text", "text": "<EMAIL_ADDRESS_1>", "content": "a@b.example"}]}]}'),
        (5, "[1]", "[1]"), (6, '{"a":' * 900 + '"x"' + "}" * 900, None),
    ]
    out = {r["id"]: r for r in payloads.mask_payload(spark.createDataFrame([r[:2] for r in rows], "id int, body string"), "body", "openai", MAIL).collect()}
    for k, body, want in rows:
        assert out[k]["masked_body"] == (want or body) and not out[k]["unreadable"], k


def test_unsafe_payloads(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = [(1, json.dumps({"input": "a@b.example \ud800 end"})), (2, f'{{"input": "a@b.example", "x": {deep}}}'), (3, '{"input": "a@b.example"}'), (4, '{"input": '), (5, None), (6, json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "", "content": "c@d.example"}]}]}))]
    out = {r["id"]: r for r in payloads.mask_payload(spark.createDataFrame(rows, "id int, body string"), "body", "openai", MAIL).collect()}
    assert json.loads(out[1]["masked_body"])["input"] == "<EMAIL_ADDRESS_1> � end" and not out[1]["unreadable"]
    assert out[2]["unreadable"] and out[2]["masked_body"] == rows[1][1] and out[4]["unreadable"] and out[4]["masked_body"] == rows[3][1]
    assert json.loads(out[3]["masked_body"])["input"] == "<EMAIL_ADDRESS_1>" and not out[3]["unreadable"] and not out[5]["unreadable"] and out[5]["masked_body"] is None
    assert json.loads(out[6]["masked_body"])["messages"][0]["content"][0]["text"] == "<EMAIL_ADDRESS_1>"


def test_audit_table_in_order(spark, tmp_path):
    """Records of a run over several partitions, and of a later run, come back newest first."""
    docs = mask.sanitize(spark.range(0, 40, numPartitions=4).selectExpr("id AS doc_id", "concat('mail u', id, '@example.com') AS text"), MAIL)
    for k, when in enumerate(("2024-05-01 10:00:00", "2024-05-02 10:00:00")):
        records = audit.audit_records(docs, f"run{k}", created_at=F.to_timestamp(F.lit(when))).withColumn("elapsed_ms", F.regexp_extract(F.lit("0"), "0", 0).cast("int"))
        audit.write_audit(records, str(tmp_path / "a"))
    rows = audit.read_audit(spark, str(tmp_path / "a"))
    got = audit.list_audits(rows, 80).collect()
    keys = [(r["append_seq"], r["append_row"]) for r in got]
    assert len(set(keys)) == 80 and keys == sorted(keys, reverse=True) and [r["request_type"] for r in got] == ["run1"] * 40 + ["run0"] * 40
    recent = audit.filter_audits(rows, since="2024-05-02 00:00:00")
    assert recent.count() == 40 and audit.filter_audits(rows, since="2030-01-01").count() == 0
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().executedPlan().toString()


def test_earlier_choices_by_order(spark):
    rows = spark.createDataFrame([("a", "X", True), ("b", "X", False)], "value string, category string, masked boolean")
    none = spark.createDataFrame([], "category string, value string")
    before = spark.createDataFrame([("a", 2, False), ("a", 1, True), ("b", 1, False), ("b", 3, True), ("b", 2, False)], "value string, ord int, masked boolean").repartition(3)
    got = {r["value"]: r["masked"] for r in filters.resolve_row_state(rows, none, none, before).collect()}
    assert got == {"a": False, "b": True}
    assert {r["masked"] for r in filters.resolve_row_state(rows, none, none, before.drop("ord")).collect()} == {True}


def streamed(spark, df, tmp_path, name, build, mode="append"):
    df.write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    ran(build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start())
    return spark.table(name)


def test_first_seen_stream_equals_batch(spark, tmp_path):
    rows = [(f"t{k % 2}", f"https://h{k % 5}.example/p/{k % 3}?q={k}", 1_700_000_000 + k) for k in range(60)]
    df = spark.createDataFrame(rows, "tag string, url string, s long").select("tag", "url", F.timestamp_seconds("s").alias("ts")).repartition(4)
    key = lambda d: sorted((r["tag"], r["route"]) for r in d.collect())
    batch = key(streams.first_seen_urls(df))
    assert len(batch) == len(set(batch)) == 30
    assert key(streamed(spark, df, tmp_path, "seen_all", lambda s: streams.first_seen_urls(s))) == batch
    assert key(streamed(spark, df, tmp_path, "seen_late", lambda s: streams.first_seen_urls(s, time="ts"))) == batch


def test_audit_windows_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1_700_000_000 + 97 * k, k % 4) for k in range(80)], "s long, detected_count int").select(F.timestamp_seconds("s").alias("ts"), "detected_count").repartition(4)
    key = lambda d: sorted((r["start"], r["records"], r["detections"]) for r in d.collect())
    got = key(streamed(spark, df, tmp_path, "windows", lambda s: streams.audit_windows(s), "complete"))
    assert got == key(streams.audit_windows(df)) and len(got) > 10


@pytest.mark.parametrize("tokens", [1, 3, 65_536])
def test_tags_of_long_documents(spark, monkeypatch, tokens):
    """Merged in stretches of any size, tags give what one pass over each document gives."""
    monkeypatch.setattr(detect, "TOKENS", tokens)
    pick = random.Random(5)
    rows = []
    for doc in (1, 2, 3, None):
        for k in range(200 if doc == 1 else 7):
            if pick.random() < 0.9:
                at = 10 * k
                rows.append((doc, k, pick.choice(["B-PER", "I-PER", "I-PER", "E-PER", "I-ORG", "O", None]), pick.choice([0.5, 0.25, None]), at, at + pick.choice([4, 4, 4, 0])))
    want = []
    for doc in (1, 2, 3, None):
        last, spans = "", []
        for _, _, tag, score, start, end in sorted((r for r in rows if r[0] == doc), key=lambda r: r[1]):
            prefix, kind = tag.split("-") if tag and "-" in tag else ("", "")
            if tag != "O" and end <= start:
                continue
            if prefix in ("I", "E") and kind == last:
                spans[-1][2:] = end, [*spans[-1][3], score or 0.0]
            elif kind:
                spans.append([kind, start, end, [score or 0.0]])
            last = kind
        want += [(doc, kind, start, end, sum(s) / len(s)) for kind, start, end, s in spans]
    got = detect.bio_spans(spark.createDataFrame(rows, "doc_id long, idx long, tag string, score double, start int, end int"))
    assert got.columns == ["doc_id", "entity_group", "start", "end", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len(want) > 30


@pytest.mark.parametrize("turns", [1, 3, 1_024])
def test_numbers_through_long_conversations(spark, monkeypatch, turns):
    """Numbered in stretches of any size, rows without keys and repeated rows among them."""
    monkeypatch.setattr(payloads, "TURNS", turns)
    pick = random.Random(7)
    word = lambda: f"W{pick.randrange(12)}"
    rows = [(conv, k, "user" if k % 4 else "assistant", f"{word()} and {word()}") for conv in (1, 2, None) for k in range(20)]
    rows += [(1, None, "user", "W99 W3"), (1, 5, "user", rows[5][3]), (3, 0, "user", None), (3, 1, "user", ""), (3, 2, None, "W1")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = payloads.mask_conversations(df, lambda t: S.regex_spans(t, "W", r"W\d+"), scope="conversation")
    assert out.columns == [*df.columns, "spans", "masked"]
    want = []
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        numbers: dict[str, int] = {}
        for _, turn, role, text in own:
            number = lambda m: f"<W_{numbers.setdefault(m[0], len(numbers) + 1)}>"
            want.append((conv, turn, re.sub(r"W\d+", number, text) if text and role == "user" else text))
    assert sorted(repr(tuple(r)) for r in out.select("conv_id", "turn", "masked").collect()) == sorted(map(repr, want))


def test_answers_are_cleaned_once(spark):
    """However often a cleaned answer is used, its patterns stand in the plan once, and no filter reads it again."""
    from maskwright.operators import answers

    docs = spark.createDataFrame([(1, "user a", '{"rewritten_text":"x","replacements":[{"original":"user","replacement":"<A_1>"}]}'), (2, "b", None), (3, "c", "no")], "doc_id long, text string, answer string")
    read = docs.withColumn("r", answers.parse_llm_replace(docs["answer"])["replacements"])
    rows = answers.rows_from_replacements(read, replacements_col="r")
    assert [(r["doc_id"], r["value"], r["count"]) for r in rows.collect()] == [(1, "user", 1)]
    for df in (rows, docs.select(answers.llm_status(answers.parse_llm_detect(docs["answer"])))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("</think>") <= 3


def test_texts_of_bodies_are_tagged_as_by_the_column(spark):
    """Texts of a body are masked over Arrow batches, with the results of ``tag_mask``: overlaps, equal spans and surfaces, null texts and lists."""
    r = random.Random(7)

    def spans(text, n):
        at = [(a, min(len(text), a + r.randint(1, 6))) for a in (r.randrange(len(text)) for _ in range(n))]
        return [(r.choice("XY"), a, b, 1.0, r.choice([text[a:b], "s"]), k, "regex") for k, (a, b) in enumerate(at)]

    texts = ["".join(r.choice("ab😀県 ") for _ in range(r.randint(1, 40))) for _ in range(300)]
    rows = [(k, [(t, spans(t, r.choice([0, 1, 2, 12]))) for t in texts[k : k + r.randint(0, 3)]]) for k in range(300)] + [(300, None), (301, [(None, [])])]
    docs = spark.createDataFrame(rows, f"id int, found array<struct<t:string,s:array<{S.SPAN}>>>").repartition(3)
    want = docs.select("id", F.transform("found", lambda x: F.when(F.size(x["s"]) > 0, mask.tag_mask(x["t"], x["s"])).otherwise(x["t"])).alias("m"))
    found = payloads.masked_texts(docs, "found", MaskConfig(), "m").select("id", "m")
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect(), key=lambda x: x[0]) == sorted(want.collect(), key=lambda x: x[0])


def test_customers_are_dealt_to_all_cores(spark):
    """A customer table of one split is worked on by all cores."""
    rows = __spark_entry__.queries()["surrogates_customers"](spark, SF)
    assert rows.rdd.getNumPartitions() >= max(10, spark.sparkContext.defaultParallelism)


def test_triggers_by_tokens(spark, duck):
    """Keywords are looked for without a join by keyword, and places of tokens aren't worked out where nothing asks for them."""
    test_query_equals_sql(spark, duck, "triggers_by_tokens")
    plan = __spark_entry__.queries()["triggers_by_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Generate posexplode(aggregate(" not in plan and "size(split(" not in plan


def test_bodies_are_parsed_once(spark):
    plan = __spark_entry__.queries()["text_segments"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(StructField(") == 2  # the body and the answer
    texts = ["", " ", "　 a  b  ", "a \n", "\u0085 ", " a", "a\n\n b", "\x1fa\x1c", "​a "]
    df = spark.createDataFrame([(i, json.dumps({"content": [{"type": "text", "text": t}, {"type": "tool", "text": "no"}]})) for i, t in enumerate(texts)], "id int, body string")
    both = df.select("id", payloads.normalized_text(F.col("body")).alias("got"), F.regexp_replace(F.get_json_object("body", "$.content[0].text"), r"(?U)^\s+|\s+$", "").alias("want")).collect()
    assert len(both) == len(texts) and all(r["got"] == r["want"] for r in both)


@pytest.mark.parametrize("name", ["default_chain", "force_mask_applied", "decisions", "validated_proper_nouns", "triggers_by_tokens", "llm_rows", "merge_llm", "rewrite_with_tags"])
def test_tables_that_grow_together_are_shuffled(spark, name):
    """None is sent whole through the driver, however small Spark takes it for."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
