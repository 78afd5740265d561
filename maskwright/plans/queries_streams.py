"""Registered queries: streams over the given tables, audit tables and test vectors, written to a shared folder and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import mask
from maskwright.sources import audit
from maskwright.sources import documents as sources
from maskwright.streaming import streams

from . import oracle as O
from .config import MaskConfig
from .memos import SQL as MEMOS
from .memos import memos
from .queries_spans import BLOCK, DOCS_FIL, FIL, FORCED, FORCED_LABELS, masked_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of ``spark.checkpoint.dir``; where none is set, in one of our own in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")


_DOCS = "SELECT doc_id, text FROM documents"


@query(f"SELECT doc_id, masked AS sanitized_text FROM ({masked_sql(_DOCS, DOCS_FIL)})")
def mask_stream(spark, sf_dir):
    """All presets on documents that arrive as a stream."""
    to = folder(spark, "masked")
    out = streams.mask_stream(arriving(spark, sf_dir)).select("doc_id", "sanitized_text")
    out.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{to}/out")


_LISTED = f"SELECT * FROM ({O.literals('documents', FORCED_LABELS)}) WHERE text NOT IN ({BLOCK})"


@query(f"SELECT doc_id, masked AS sanitized_text FROM ({masked_sql(_DOCS, _LISTED)})")
def list_updates(spark, sf_dir):
    """A stream masked by the force list as it stands at each batch."""
    to = folder(spark, "listed")
    lists = lambda: spark.createDataFrame(FORCED, "value string, category string")
    sink = lambda batch, number: batch.select("doc_id", "sanitized_text").write.mode("overwrite").parquet(f"{to}/out/batch={number}")
    streams.with_lists(arriving(spark, sf_dir), lists, sink, f"{to}/state", MaskConfig(presets=False)).awaitTermination()
    return spark.read.parquet(f"{to}/out").drop("batch")


_COUNTS = "SELECT d.doc_id, CAST(coalesce(c.n, 0) AS INTEGER) AS detected_count, CAST(coalesce(c.emails, 0) AS INTEGER) AS emails FROM ({docs}) d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (entity_type = 'EMAIL_ADDRESS') AS emails FROM ({spans}) GROUP BY doc_id) c ON d.doc_id = c.doc_id"


def _summed(records: DataFrame) -> DataFrame:
    emails = F.coalesce(F.try_element_at("entity_summary", F.lit("EMAIL_ADDRESS")), F.lit(0)).alias("emails")
    return records.groupBy("day", "detected_count", emails).agg(F.count("*").alias("records"), F.countDistinct("append_row").alias("rows"))


@query(f"SELECT DATE '2024-03-01' + CAST(doc_id % 5 AS INTEGER) AS day, detected_count, emails, count(*) AS records FROM ({_COUNTS.format(docs=MEMOS, spans=FIL)}) GROUP BY ALL")
def audit_table(spark, sf_dir):
    """Records appended to a table by day, and read from it."""
    to = folder(spark, "audits")
    when = F.timestamp_seconds(F.unix_timestamp(F.date_add(F.lit("2024-03-01").cast("date"), (F.col("doc_id") % 5).cast("int"))))
    audit.write_audit(audit.audit_records(mask.sanitize(memos(spark, sf_dir)), "memo", created_at=when), to)
    return _summed(audit.read_audit(spark, to)).drop("rows")


@query(f"SELECT detected_count, emails, count(*) AS records, count(*) AS rows FROM ({_COUNTS.format(docs=_DOCS, spans=DOCS_FIL)}) GROUP BY ALL")
def audit_stream(spark, sf_dir):
    """Records of a stream of documents: one each, every one in a place of its own."""
    to = folder(spark, "audits")
    streams.audit_stream(mask.sanitize(arriving(spark, sf_dir)), f"{to}/out", f"{to}/state").awaitTermination()
    return _summed(audit.read_audit(spark, f"{to}/out")).groupBy("detected_count", "emails").agg(F.sum("records").alias("records"), F.sum("rows").alias("rows"))


@query("SELECT 'G' || CAST(s_suppkey // 1000 AS VARCHAR) AS groups, CASE WHEN s_suppkey // 1000 % 2 = 0 THEN 'aggregation' ELSE 'detection' END AS mode, s_name AS name, 'call ' || s_name AS input, CAST(s_suppkey AS VARCHAR) AS expected FROM supplier")
def read_vectors(spark, sf_dir):
    """Test vectors, a file for each thousand suppliers, as rows of cases; files without a mode are of detection."""
    to = folder(spark, "vectors")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("k", F.floor(F.col("s_suppkey") / 1000))
    expected = F.array(F.struct(F.lit("ID").alias("label"), F.col("s_suppkey").cast("string").alias("text")))
    case = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("call "), "s_name").alias("input"), expected.alias("expected"))
    mode = F.when(F.col("k") % 2 == 0, "aggregation").alias("mode")
    s.groupBy("k", F.array(F.concat(F.lit("G"), F.col("k").cast("string"))).alias("label_groups"), mode).agg(F.collect_list(case).alias("cases")).write.partitionBy("k").json(to)
    return sources.read_vectors(spark, to).select(F.col("label_groups")[0].alias("groups"), "mode", "name", "input", F.col("expected")[0]["text"].alias("expected"))
