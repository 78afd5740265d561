"""Audit records: built from masked documents, appended to a table, queried newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.aggregate import entity_summary

SCHEMA = "audit_id string, request_type string, filter_enabled boolean, detected_count int, entity_summary map<string,int>, upstream_target string, status string, elapsed_ms int, created_at string, append_seq long, append_row long, batch long, day date"


def audit_records(docs: DataFrame, request_type: str = "text", enabled: bool = True, upstream: str | None = None, created_at: Column | None = None, status: str = "ok") -> DataFrame:
    """A record for each masked document of a table or of a stream's batch; (``append_seq``, ``append_row``) grows with time, and
    within a run with partition and row."""
    now = F.current_timestamp() if created_at is None else created_at
    return docs.select(
        F.uuid().alias("audit_id"), F.lit(request_type).alias("request_type"), F.lit(enabled).alias("filter_enabled"), F.size("spans").alias("detected_count"), entity_summary(F.col("spans")).alias("entity_summary"),
        F.lit(upstream).cast("string").alias("upstream_target"), F.lit(status).alias("status"), F.lit(None).cast("int").alias("elapsed_ms"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
        F.unix_micros(now.cast("timestamp")).alias("append_seq"), F.monotonically_increasing_id().alias("append_row"), F.to_date(now).alias("day"),
    )


def write_audit(records: DataFrame, path: str, format: str = "json") -> None:
    """Appends records, in a folder for each day, so that ``since`` leaves earlier days unread."""
    records.write.mode("append").format(format).partitionBy("day").save(path)


def read_audit(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(SCHEMA).format(format).load(path)


def filter_audits(audits: DataFrame, since: str | None = None, entity_type: str | None = None, action: str | None = None) -> DataFrame:
    """``since`` is inclusive and drops unreadable times; ``action`` masked or allowed, any other finds nothing."""
    out = audits
    if since is not None:
        if "day" in out.columns:  # a day earlier, as days are those of the session that wrote them
            out = out.where(F.col("day") >= F.date_sub(F.to_date(F.to_timestamp(F.lit(since))), 1))
        out = out.where(F.try_to_timestamp(F.col("created_at")) >= F.to_timestamp(F.lit(since)))
    if entity_type is not None:
        out = out.where(F.coalesce(F.try_element_at("entity_summary", F.lit(entity_type)), F.lit(0)) > 0)
    if action is not None:
        count = F.coalesce("detected_count", F.lit(0))
        out = out.where({"masked": F.col("filter_enabled") & (count > 0), "allowed": F.col("filter_enabled") & (count == 0)}.get(action, F.lit(False)))
    return out


def list_audits(audits: DataFrame, limit: int = 100, since: str | None = None, entity_type: str | None = None, action: str | None = None) -> DataFrame:
    """The newest records that pass the filters, from 1 to 10000 of them."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be from 1 to 10000")
    order = [F.desc(c) for c in ("append_seq", "batch", "append_row", "created_at") if c in audits.columns]
    return filter_audits(audits, since, entity_type, action).orderBy(*order).limit(limit)
