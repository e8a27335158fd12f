"""Disparity over event-time windows of a stream of decisions: the batch counts, kept per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import group_label
from ..operators import gate
from ..operators.disparity import METRICS, AuditSpec, _counts, group_rates, require_columns, summary


def windowed_confusion(events: DataFrame, spec: AuditSpec, ts: str, window: str, watermark: str | None = None) -> DataFrame:
    """window_start, group and counts; for static and streaming input alike. State is one row per open window and group."""
    late = events.withWatermark(ts, watermark) if watermark else events
    require_columns(late, [*spec.columns, ts])
    rows = late.select(F.col(spec.truth).alias("truth"), F.col(spec.pred or spec.truth).alias("pred"), F.col(ts), group_label(*spec.groups).alias("group"))
    counted = rows.groupBy(F.window(ts, window).alias("w"), "group").agg(*_counts())
    return counted.select(F.col("w.start").alias("window_start"), *[c for c in counted.columns if c != "w"])


def window_summaries(counts: DataFrame) -> DataFrame:
    """window_start, n_total and the four metrics."""
    return summary(group_rates(counts), "window_start")


def gate_windows(counts: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """window_start, status of each window."""
    one = window_summaries(counts)
    parts = one.unpivot(["window_start"], list(METRICS), "check", "value")
    limits = gate.threshold_table(counts.sparkSession, thresholds)
    ok = F.when(F.col("op") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    found = parts.join(F.broadcast(limits), "check").withColumn("status", F.when(F.col("value").isNull(), "skipped").when(ok, "pass").otherwise("fail"))
    return gate.status(found, "window_start")


def start_gate(events: DataFrame, spec: AuditSpec, ts: str, window: str, watermark: str, sink, checkpoint: str, **trigger):
    """Start the stream; sink(batch of window_start, status, batch id) gets the gated windows of each micro-batch that closed."""
    counts = windowed_confusion(events, spec, ts, window, watermark)

    def each(batch: DataFrame, number: int) -> None:
        sink(gate_windows(batch), number)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
