"""Roll-ups of measurements: histograms, traces, deployment metrics, concurrency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default bucket bounds in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts by upper bound (the last is infinite), with sum and count. One map-side combined aggregation."""
    bounds = bounds or BUCKETS
    sums = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_b{k}") for k, b in enumerate(bounds)], F.count(value).alias("count"), F.sum(value).alias("sum"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return sums.select(*keys, F.inline(pairs), "count", "sum")


def prometheus(df: DataFrame, name: str, labels: list[str], value: str) -> Column:
    """A line of the text format for each row."""
    marks = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return F.concat(F.lit(name + "{"), marks, F.lit("} "), F.col(value).cast("string"))


def parsed_prometheus(line: str) -> dict[str, Column]:
    """Name, labels and value columns of a line."""
    return {"name": F.regexp_extract(line, r"^(\w+)\{", 1), "label": F.regexp_extract(line, r'="([^"]*)"', 1), "value": F.regexp_extract(line, r" (\S+)$", 1).cast("double")}


def waterfall(spans: DataFrame) -> DataFrame:
    """Each span with its offset and share of the trace, and whether it is the first longest one."""
    w = Window.partitionBy("trace_id")
    start, end = F.min("start_ms").over(w), F.max("end_ms").over(w)
    longest = F.row_number().over(w.orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "start_ms", "span_id")) == 1
    return spans.select("trace_id", "span_id", (F.col("start_ms") - start).alias("offset_ms"), (100.0 * (F.col("end_ms") - F.col("start_ms")) / F.nullif(end - start, F.lit(0))).alias("percent"), longest.alias("bottleneck"))


def peak_concurrency(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The most intervals that are open at once; one that ends as another starts is closed first."""
    points = intervals.select(*keys, F.col("start_ms").alias("t"), F.lit(1).alias("d")).unionAll(intervals.select(*keys, F.col("end_ms").alias("t"), F.lit(-1).alias("d")))
    open_now = F.sum("d").over(Window.partitionBy(*keys).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn("_open", open_now).groupBy(*keys).agg(F.max("_open").alias("peak"))


def phase_metrics(df: DataFrame, keys: list[str], phases: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(p).alias(f"{p}_{n}") for p in phases for n, f in (("sum", F.sum), ("max", F.max))])


def failure_windows(events: DataFrame, keys: list[str], window_ms: int, limit: int) -> DataFrame:
    """Each event with how many its key had in the window that ends with it, and whether that is over the limit."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("at_ms").rangeBetween(-window_ms + 1, 0))
    return events.withColumn("in_window", n).withColumn("blocked", F.col("in_window") > limit)


def in_flight_report(attempts: DataFrame, keys: list[str], max_attempts: int) -> DataFrame:
    """The account of each executor's calls: submitted, attempts, retries, completed, failed, exhausted, the most in flight, and retries by reason.

    attempts: the keys, operation_id, start_ms, end_ms, ok, retryable, reason_code. Attempts of an operation follow each other in order of
    starts; a chain ends with one that is ok, cannot be retried, or is the last that max_attempts allows, and a later one begins a
    new submission. A retry is an attempt that another of its chain follows; a chain whose last attempt is not ok has
    failed, and is exhausted if that could have been retried. In-flight counts come from a sweep over starts and ends.
    """
    w = Window.partitionBy(*keys, "operation_id").orderBy("start_ms", "end_ms")
    final = F.col("ok") | ~F.coalesce("retryable", F.lit(False))
    # chains end at final attempts, and within a run of others at every max_attempts-th
    at = attempts.withColumn("_final", final).withColumn("_run", F.coalesce(F.sum(F.col("_final").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "operation_id", "_run").orderBy("start_ms", "end_ms")))
    limit = F.col("_n") % max_attempts == 0
    followed = F.lead("_run").over(w).isNotNull()
    at = at.withColumn("_last", F.col("_final") | limit | ~followed).withColumn("_exhausted", ~F.col("_final") & limit)
    retried = ~F.col("_last")
    sums = at.groupBy(*keys).agg(
        F.count_if("_last").alias("submitted"), F.count(F.lit(1)).alias("attempts"), F.count_if(retried).alias("retries"), F.count_if(F.col("_last") & F.col("ok")).alias("completed"),
        F.count_if(F.col("_last") & ~F.col("ok")).alias("failed"), F.count_if(F.col("_exhausted")).alias("exhausted"),
    )
    reasons = at.where(retried).groupBy(*keys, "reason_code").agg(F.count(F.lit(1)).alias("_n"))
    told = reasons.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason_code", F.col("_n").cast("string")))), ",").alias("throttle_events"))
    peak = peak_concurrency(attempts, keys).withColumnRenamed("peak", "peak_in_flight")
    return sums.join(told, keys, "left").join(peak, keys, "left").na.fill({"throttle_events": ""})
