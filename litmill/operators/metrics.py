"""Service metrics from event rows. The same functions serve tables and streams; a stream gets a watermark.

events: ts, label columns, status flags and values. Histograms are counted in the grouping itself: one
cumulative count per bucket, so a label that holds most rows is reduced where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.skew import running_sum
from litmill.functions.text import let

WATERMARK = "10 minutes"


def _timed(events: DataFrame, late: str = WATERMARK) -> DataFrame:
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _flat(rows: DataFrame) -> DataFrame:
    """The window as two columns."""
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in rows.columns if c != "window"])


# ---- quantiles from buckets ------------------------------------------------------------------------


def bucket_counts(value: str, buckets: Sequence[float]) -> Column:
    """Cumulative counts per upper bound, all values last."""
    return F.array(*[F.count_if(F.col(value) <= b) for b in buckets], F.count(value))


def quantile_of(cumulative: Column, q: float, buckets: Sequence[float]) -> Column:
    """Linear inside the bucket that holds the rank; beyond the last bound, that bound."""
    bounds = F.array(*[F.lit(float(b)) for b in buckets])

    def inside(c: Column) -> Column:
        rank = F.element_at(c, -1) * q
        i = F.size(F.filter(c, lambda x: x < rank))
        lo = F.when(i > 0, F.get(bounds, i - 1)).otherwise(0.0)
        below = F.when(i > 0, F.get(c, i - 1)).otherwise(F.lit(0))
        here = F.get(c, i) - below
        return F.when(F.element_at(c, -1) == 0, F.lit(None).cast("double")).when(i >= len(buckets), F.lit(float(buckets[-1]))).otherwise(
            F.when(here > 0, lo + (F.get(bounds, i) - lo) * ((rank - below) / here)).otherwise(F.get(bounds, i))
        )

    return let(cumulative, inside)


def bucket_quantile(events: DataFrame, keys: list[str], value: str = "value", qs: Sequence[float] = (0.5, 0.95), buckets: Sequence[float] = tuple(fv.REQUEST_BUCKETS)) -> DataFrame:
    """(keys, n, one column per quantile such as p95)."""
    counts = events.groupBy(*keys).agg(F.count(value).alias("n"), bucket_counts(value, buckets).alias("_c"))
    return counts.select(*keys, "n", *[quantile_of(F.col("_c"), q, buckets).alias(f"p{round(q * 100)}") for q in qs])


# ---- windows ---------------------------------------------------------------------------------------------


def request_rates(events: DataFrame, is_error: Column) -> DataFrame:
    """Requests and failed requests per second for each minute."""
    rows = _timed(events).groupBy(F.window("ts", "1 minute")).agg(
        (F.count("*") / 60).alias("requests_per_s"), (F.count_if(is_error) / 60).alias("errors_per_s")
    )
    return _flat(rows)


def error_rates(events: DataFrame, labels: list[str], is_error: Column) -> DataFrame:
    """Errors by label over five minutes, every minute: rate per second and increase."""
    rows = _timed(events.where(is_error)).groupBy(F.window("ts", "5 minutes", "1 minute"), *labels).agg(F.count("*").alias("increase"))
    return _flat(rows.withColumn("errors_per_s", F.col("increase") / 300))


def latency_quantiles(events: DataFrame, labels: list[str], value: str = "value", buckets: Sequence[float] = tuple(fv.REQUEST_BUCKETS)) -> DataFrame:
    """p50 and p95 by label over five minutes, every minute."""
    rows = _timed(events).groupBy(F.window("ts", "5 minutes", "1 minute"), *labels).agg(F.count("*").alias("n"), bucket_counts(value, buckets).alias("_c"))
    rows = rows.withColumn("p50", quantile_of(F.col("_c"), 0.5, buckets)).withColumn("p95", quantile_of(F.col("_c"), 0.95, buckets)).drop("_c")
    return _flat(rows)


def metric_totals(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("total"), F.max("ts").alias("last_ts"))


# ---- alerts ------------------------------------------------------------------------------------------------

# (rule, measure, threshold, minutes the condition must hold)
RULES = [
    ("HighModelErrorRate", "errors_per_s", 0.1, 2),
    ("RateLimitHit", "limit_hits", 0.0, 0),
    ("AllModelsExhausted", "exhausted", 0.0, 0),
    ("HighLatency", "p95", 30.0, 5),
    ("HighErrorRate", "error_share", 0.1, 5),
]


def five_minute_measures(events: DataFrame, label: str, is_error: Column, is_limit: Column, is_exhausted: Column, value: str = "value") -> DataFrame:
    """(window_end, label, measures): everything the alert rules look at, in one grouping."""
    rows = _timed(events).groupBy(F.window("ts", "5 minutes", "1 minute"), F.col(label).alias("label")).agg(
        (F.count_if(is_error) / 300).alias("errors_per_s"),
        F.count_if(is_limit).cast("double").alias("limit_hits"),
        F.count_if(is_exhausted).cast("double").alias("exhausted"),
        bucket_counts(value, fv.REQUEST_BUCKETS).alias("_c"),
        (F.count_if(is_error) / F.count("*")).alias("error_share"),
    )
    return _flat(rows.withColumn("p95", quantile_of(F.col("_c"), 0.95, fv.REQUEST_BUCKETS)).drop("_c"))


def breaches(measures: DataFrame, rules: list[tuple[str, str, float, int]] | None = None) -> DataFrame:
    """(rule, label, minute, value, hold): evaluations whose measure exceeds its threshold."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.lit(h).alias("hold"))
            for n, m, t, h in rules or RULES
        ]
    )
    out = measures.select(F.col("window_end").alias("minute"), "label", F.explode(rows).alias("r")).select("minute", "label", "r.*")
    return out.where("value > threshold").select("rule", "label", "minute", "value", "hold")


def alerts(measures: DataFrame, rules: list[tuple[str, str, float, int]] | None = None) -> DataFrame:
    """(rule, label, minute, value, since): breaches that have held without a break for the time of their rule.

    Groups are one row per rule, label and minute, so their size follows the time covered, not the traffic.
    """
    b = breaches(measures, rules).withColumn("m", F.floor(_seconds("minute") / 60))
    w = Window.partitionBy("rule", "label").orderBy("m")
    b = b.withColumn("g", F.col("m") - F.row_number().over(w))
    since = F.min("minute").over(Window.partitionBy("rule", "label", "g"))
    held = (_seconds("minute") - _seconds("since")) >= F.col("hold") * 60
    return b.withColumn("since", since).where(held).select("rule", "label", "minute", "value", "since")


def absence_alerts(events: DataFrame, label: str, minutes: int = 1, as_of: Column | None = None) -> DataFrame:
    """(label, absent_from, absent_to, minutes): runs of minutes without any event of a label, longer than ``minutes``.

    A label that is silent now has a run up to the minute of ``as_of``, else of the last event of any label.
    """
    seen = events.select(F.col(label).alias("label"), F.date_trunc("minute", "ts").alias("m")).distinct()
    w = Window.partitionBy("label").orderBy("m")
    if as_of is None:
        as_of = events.agg(F.max("ts").alias("t")).select("t").scalar()
    gap = seen.withColumn("nxt", F.coalesce(F.lead("m").over(w), F.date_trunc("minute", as_of)))
    n = F.floor((_seconds("nxt") - _seconds("m")) / 60) - 1
    rows = gap.withColumn("minutes", n.cast("bigint")).where(F.col("minutes") > minutes)
    return rows.select("label", (F.col("m") + F.expr("interval 1 minute")).alias("absent_from"), F.col("nxt").alias("absent_to"), "minutes")


def active_requests(events: DataFrame, key: str, duration: str = "value") -> DataFrame:
    """(key, at, active): requests in flight after every start and end, for keys of any size.

    events: ts and a duration in seconds. Ends come before starts at the same moment.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    marks = F.array(
        F.struct(us.alias("us"), F.lit(1).alias("delta")),
        F.struct((us + F.round(F.col(duration) * 1_000_000).cast("bigint")).alias("us"), F.lit(-1).alias("delta")),
    )
    rows = events.select(key, F.explode(marks).alias("m")).groupBy(key, "m.us", "m.delta").agg(F.count("*").alias("c"))
    rows = rows.groupBy(key, "us").agg(F.sum(F.col("delta") * F.col("c")).alias("change"))
    out = running_sum(rows, [key], ["us"], F.col("change"), F.floor(F.col("us") / 3_600_000_000), "active")
    return out.select(key, F.timestamp_micros("us").cast("timestamp_ntz").alias("at"), "active")
