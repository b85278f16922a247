"""Values that compare consecutive polls of the same key."""

from pyspark.sql import functions as F

from ..functions.ordered import carried, top_n

# Polls per chunk when ``chunk`` is not given: the time a chunk spans, in the
# unit of the order column.
CHUNK_SPAN = 6 * 3600


def with_previous(df, keys, ts, columns, span=CHUNK_SPAN):
    """Add ``prev_<column>`` (and ``prev_<ts>``) from the previous poll of the key."""
    chunked = df.withColumn("_chunk", F.floor(F.col(ts) / span))
    lags = {f"prev_{c}": F.col(c) for c in [ts, *columns]}
    return carried(chunked, keys, ["_chunk"], [ts], lag=lags).drop("_chunk")


def counter_rate(df, keys, ts, value, span=CHUNK_SPAN):
    """Change per second since the previous poll; a reset shows as a negative rate."""
    seen = with_previous(df, keys, ts, [value], span)
    return seen.withColumn("rate", rate_since(ts, value)).drop(f"prev_{ts}", f"prev_{value}")


def rate_since(ts, value):
    """Change per second since the previous poll that :func:`with_previous` found; none without time between."""
    dt = F.col(ts) - F.col(f"prev_{ts}")
    return F.when(dt > 0, (F.col(value) - F.col(f"prev_{value}")) / F.nullif(dt.cast("double"), F.lit(0.0)))


def task_rates(samples, keys=("app_id",), ts="poll_s", span=CHUNK_SPAN):
    """Completed tasks per second between polls, to a tenth; the first poll has none."""
    seen = with_previous(samples, list(keys), ts, ["completed_tasks"], span)
    dt = F.greatest((F.col(ts) - F.col(f"prev_{ts}")).cast("double"), F.lit(0.001))
    done = F.greatest(F.col("completed_tasks") - F.col("prev_completed_tasks"), F.lit(0))
    return seen.withColumn("rate", F.round(F.lit(10.0) * done / dt) / 10).drop(f"prev_{ts}", "prev_completed_tasks")


def task_rate(samples, keys=("app_id",), ts="poll_s", span=CHUNK_SPAN):
    """Task rate and active tasks per app: now and peak."""
    rates = task_rates(samples, keys, ts, span)
    has = F.when(F.col("rate").isNotNull(), F.col(ts))
    return rates.groupBy(*keys).agg(
        F.coalesce(F.max_by("rate", has), F.lit(0.0)).alias("now_rate"),
        F.coalesce(F.max("rate"), F.lit(0.0)).alias("peak_rate"),
        F.max_by("active_tasks", ts).alias("now_active"),
        F.max("active_tasks").alias("peak_active"),
    )


def executor_churn(samples, keys=("app_id",), ts="poll_s"):
    """Executors alive now and at peak, and how many were removed over the samples."""
    removed = F.max_by("removed_executors", ts) - F.min_by("removed_executors", ts)
    return samples.groupBy(*keys).agg(
        F.max_by("alive_executors", ts).alias("now_alive"),
        F.max("alive_executors").alias("peak_alive"),
        F.greatest(removed, F.lit(0)).alias("removed_in_window"),
    )


def samples_of(executors, keys=("app_id", "poll_s")):
    """One sample per poll from the executor table of each poll."""
    alive = F.col("is_active") & (F.col("executor_id") != "driver")
    return executors.groupBy(*keys).agg(
        F.sum("completed_tasks").alias("completed_tasks"),
        F.sum("active_tasks").alias("active_tasks"),
        F.count_if(alive).alias("alive_executors"),
        F.count_if(~F.col("is_active")).alias("removed_executors"),
    )


def last_samples(samples, n, keys=("app_id",), ts="poll_s"):
    """The last ``n`` polls, as a chart shows them."""
    return top_n(samples, list(keys), [F.desc(ts)], n, [ts]).drop("rank")


def metric_series(metrics, keys=("app_id", "key"), ts="poll_s", n=None, span=CHUNK_SPAN):
    """The one number of a metric worth charting, at every poll or its last ``n``."""
    rated = counter_rate(metrics, list(keys), ts, "value", span)
    kind = F.col("kind")
    point = (
        F.when(kind == "gauge", F.col("value"))
        .when(kind == "counter", F.col("rate"))
        .when(kind == "meter", F.col("m1_rate"))
        .otherwise(F.col("mean"))
    )
    rated = rated.withColumn("point", point)
    return rated if n is None else top_n(rated, list(keys), [F.desc(ts)], n, [ts])
