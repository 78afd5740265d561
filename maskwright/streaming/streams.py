"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.operators import detect, mask
from maskwright.plans.config import MaskConfig
from maskwright.sources import audit


def mask_stream(texts: DataFrame, cfg: MaskConfig | None = None) -> DataFrame:
    """Masked texts in append mode; no state."""
    return mask.sanitize(texts, cfg)


def audit_stream(masked: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit records appended exactly once for each batch, with ``batch`` and a running ``append_row`` within it, so that their order
    is total. A batch fills a folder of its own; one that is run again after a failure fills the same folder anew."""

    def each(batch: DataFrame, number: int) -> None:
        audit.audit_records(batch).write.mode("overwrite").format("json").partitionBy("day").save(f"{path}/batch={number}")

    return masked.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(detections: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Detections so far by session; for update or complete mode."""
    return detections.groupBy(key).agg(F.sum(count).alias("detections"))


def first_seen_urls(events: DataFrame, tag: str = "tag", url: str = "url", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first event of each (tag, host and path); with a time column, state older than the delay is dropped."""
    route = F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://([^?#]*)", 1)
    named = events.withColumn("route", F.when(route != "", route).otherwise(F.col(url)))
    return named.withWatermark(time, delay).dropDuplicatesWithinWatermark([tag, "route"]) if time else named.dropDuplicates([tag, "route"])


def with_lists(texts: DataFrame, lists: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: MaskConfig | None = None) -> StreamingQuery:
    """Masks each micro-batch with the force list as it stands then: ``lists`` is read anew for every batch.

    The list's spans come as a column of each row, so rows may share an id or have none.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = detect.with_occurrences(batch, lists(), into="__found")
        listed = found.withColumn("__listed", detect.listed_spans(F.col("__found"))).drop("__found")
        sink(mask.sanitize(listed, cfg, statistical="__listed").drop("__listed"), number)

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_windows(audits: DataFrame, size: str = "10 minutes", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Records and detections by tumbling window, with a watermark on streams."""
    source = audits.withWatermark(time, delay) if audits.isStreaming else audits
    return source.groupBy(F.window(time, size)).agg(F.count("*").alias("records"), F.sum("detected_count").alias("detections")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "records", "detections")
