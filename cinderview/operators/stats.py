"""Task statistics of stages: quantiles, skew, stragglers, executors, locality.

The functions take a DataFrame, key columns and measure columns, so they also
profile ordinary tables.
"""

from pyspark.sql import Window, functions as F

from ..functions.filters import FILTER_FIELDS, text_filter, with_stage_key
from ..functions.ordered import all_of, order_statistics, top_n
from ..functions.text import fixed, ratio_text
from ..session import written

# Reported quantiles and their labels.
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
# Display order and unit of the task metrics.
TASK_METRICS = [
    ("duration", "ms"),
    ("gc time", "ms"),
    ("sched delay", "ms"),
    ("input", "bytes"),
    ("shuffle read", "bytes"),
    ("fetch wait", "ms"),
    ("shuffle write", "bytes"),
    ("mem spill", "bytes"),
    ("disk spill", "bytes"),
    ("peak exec mem", "bytes"),
]
# Smallest maximum that can count as skew, per unit.
SKEW_FLOOR = {"ms": 1000.0, "bytes": 1048576.0}
SKEW_RATIO = 3.0
MEDIAN_FLOOR_MS = 100.0
SLOW_EXECUTOR_RATIO = 2.0
# Locality levels in display order.
LOCALITIES = ["PROCESS_LOCAL", "NODE_LOCAL", "NO_PREF", "RACK_LOCAL", "ANY"]

STAGE = ["app_id", "stage_id", "attempt_id"]


def nearest_rank(q):
    """Rank of quantile ``q`` among ``n`` sorted values, counted from 0."""
    return lambda n: F.least(F.floor(F.lit(float(q)) * n), n - 1)


def middle_rank(n):
    """Rank of the upper median."""
    return F.floor(n / 2)


def succeeded(tasks):
    return tasks.where(F.col("status") == "SUCCESS")


def quantiles(df, keys, measures, quantile_of=None):
    """Exact quantiles per key and measure, in long form."""
    qs = quantile_of or QUANTILES
    ranks = {label: nearest_rank(q) for label, q in qs.items()}
    return order_statistics(df, keys, measures, ranks)


def approx_quantiles(df, keys, measures, quantile_of=None, accuracy=10000):
    """Sketch-based quantiles: one pass, bounded state, error at most 1/accuracy of the rows."""
    qs = quantile_of or QUANTILES
    arrays = [
        F.percentile_approx(F.col(col).cast("double"), list(qs.values()), accuracy).alias(f"_{i}")
        for i, col in enumerate(measures.values())
    ]
    packed = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"_{i}").alias("v")) for i, m in enumerate(measures)]
    )
    rows = df.groupBy(*keys).agg(*arrays).select(*keys, F.explode(packed).alias("p"))
    return rows.where(F.col("p.v").isNotNull()).select(
        *keys, "p.metric", *[F.col("p.v")[i].alias(label) for i, label in enumerate(qs)]
    )


def skew(df, keys, measures, ratio=SKEW_RATIO):
    """``max / median`` per key and measure; ``measures`` maps name to (column, unit)."""
    stats = quantiles(df, keys, {m: col for m, (col, _) in measures.items()}, {"median": 0.5, "max": 1.0})
    return with_skew(stats, {m: unit for m, (_, unit) in measures.items()}, ratio)


def with_skew(stats, unit_of, ratio=SKEW_RATIO):
    """Add ``ratio`` (null below the noise floor) and ``flagged`` to median/max rows."""
    floor = F.coalesce(*[F.when(F.col("metric") == m, F.lit(SKEW_FLOOR[u])) for m, u in unit_of.items()])
    value = F.when(F.col("median") > 0, F.col("max") / F.nullif(F.col("median"), F.lit(0.0))).otherwise(
        F.lit(float("inf"))
    )
    return stats.withColumn("ratio", F.when(F.col("max") >= floor, value)).withColumn(
        "flagged", F.coalesce(F.col("ratio") >= ratio, F.lit(False))
    )


def skew_text_of_group():
    """Aggregate over a key's metrics: the flagged ones with their ratio, in display order."""
    rank = F.array_position(F.array(*[F.lit(m) for m, _ in TASK_METRICS]), F.col("metric"))
    item = F.struct(rank.alias("o"), F.concat(F.col("metric"), F.lit(" ×"), ratio_text("ratio")).alias("t"))
    items = F.array_sort(F.collect_list(F.when(F.col("flagged"), item)))
    return F.nullif(F.array_join(F.transform(items, lambda x: x["t"]), ", "), F.lit(""))


def skew_text(skewed, keys):
    """One text per key that has a flagged metric."""
    return skewed.groupBy(*keys).agg(skew_text_of_group().alias("skew")).where(F.col("skew").isNotNull())


def median_duration(tasks, summary, keys=STAGE):
    """Median task time per key: from ``summary`` (``keys, p50``), else the upper median of its succeeded tasks."""
    fallback = order_statistics(succeeded(tasks), keys, {"d": "duration_ms"}, {"upper": middle_rank})
    groups = tasks.groupBy(*keys).agg(F.lit(1).alias("_one")).drop("_one")
    return (
        groups.join(summary.select(*keys, "p50"), keys, "left")
        .join(fallback.select(*keys, "upper"), keys, "left")
        .select(*keys, F.coalesce("p50", "upper", F.lit(0.0)).alias("median_ms"))
    )


def is_straggler(duration, median, ratio=SKEW_RATIO):
    return (F.col(median) >= MEDIAN_FLOOR_MS) & (F.col(duration) >= F.col(median) * ratio)


def stragglers(df, keys, duration, ratio=SKEW_RATIO, of=None):
    """Rows at least ``ratio`` times the median of their key (medians of 100 ms and more).

    ``of`` is the population of the median; by default all of ``df``.
    """
    base = df if of is None else of
    medians = quantiles(base, keys, {"d": duration}, {"median_ms": 0.5}).select(*keys, "median_ms")
    late = medians.where(F.col("median_ms") >= MEDIAN_FLOOR_MS)
    hit = df.join(late, keys).where(is_straggler(duration, "median_ms", ratio))
    times = F.col(duration) / F.greatest(F.col("median_ms"), F.lit(1.0))
    return hit.withColumn("note", F.concat(F.lit("straggler ×"), fixed(times, 1)))


def slowest_tasks(tasks, keys, n, order="duration_ms"):
    """The ``n`` longest tasks per key; ties by task id."""
    sort = [F.desc(order), F.asc("task_id"), F.asc("attempt"), F.asc("executor_id")]
    return top_n(tasks, keys, sort, n, ["task_id", "attempt", "executor_id"])


def failed_tasks(tasks):
    return tasks.where(F.col("status") == "FAILED")


def rollup_executors(tasks, keys=STAGE):
    """Per executor totals of a stage from its tasks."""
    one = lambda s: F.count_if(F.col("status") == s)
    return tasks.groupBy(*keys, "executor_id").agg(
        F.sum("duration_ms").alias("task_time"),
        one("SUCCESS").alias("succeeded_tasks"),
        one("FAILED").alias("failed_tasks"),
        one("KILLED").alias("killed_tasks"),
        F.sum("shuffle_read_bytes").alias("shuffle_read"),
        F.sum("spill_bytes").alias("memory_bytes_spilled"),
    )


def executor_flags(stage_executors, keys=STAGE):
    """Executors that failed tasks, are excluded, or run at twice the stage mean."""
    n = F.col("succeeded_tasks") + F.col("failed_tasks") + F.col("killed_tasks")
    mean = lambda time, count: F.when(count > 0, time / F.nullif(count, F.lit(0))).otherwise(F.lit(0.0))
    rows = stage_executors.withColumn("tasks", n)
    # A stage has one row per executor here, so its window is small.
    stage = Window.partitionBy(*keys)
    rows = rows.withColumn("mean_ms", mean(F.col("task_time"), F.col("tasks"))).withColumn(
        "stage_mean_ms", mean(F.sum("task_time").over(stage), F.sum("tasks").over(stage))
    )
    rows = rows.where(all_of([F.col(k).isNotNull() for k in keys]))
    slow = (F.col("stage_mean_ms") >= MEDIAN_FLOOR_MS) & (
        F.col("mean_ms") >= F.col("stage_mean_ms") * SLOW_EXECUTOR_RATIO
    )
    times = F.col("mean_ms") / F.nullif(F.col("stage_mean_ms"), F.lit(0.0))
    reason = F.concat_ws(
        " · ",
        F.when(F.col("failed_tasks") > 0, F.concat(F.col("failed_tasks").cast("string"), F.lit(" failed"))),
        F.when(F.col("is_excluded"), F.lit("excluded")),
        F.when(slow, F.concat(fixed(times, 1), F.lit("× stage avg"))),
    )
    return rows.withColumn("reason", reason).withColumn("flagged", F.col("reason") != "")


def executor_order(flagged, keys=STAGE):
    """Flagged executors of a stage first, then by task time."""
    return flagged.orderBy(*keys, F.desc("flagged"), F.desc("task_time"), F.asc("executor_id"))


def locality(tasks, keys=STAGE):
    """Locality histogram text per key over all its tasks, and whether most ran away from their data."""
    return locality_of_counts(tasks.groupBy(*keys, "locality").agg(F.count(F.lit(1)).alias("n")), keys)


def locality_of_counts(counts, keys, more=()):
    """:func:`locality` from tasks counted by level (``keys, locality, n``); ``more`` are further aggregates per key."""
    known = F.array_position(F.array(*[F.lit(x) for x in LOCALITIES]), F.col("locality"))
    rank = F.when(known > 0, known).otherwise(F.lit(len(LOCALITIES) + 1))
    blank = F.coalesce(F.col("locality"), F.lit("")) == ""
    item = F.when(
        ~blank,
        F.struct(rank.alias("o"), F.col("locality").alias("l"),
                 F.concat_ws(" ", "locality", F.col("n").cast("string")).alias("t")),
    )
    groups = counts.groupBy(*keys).agg(
        F.sum("n").alias("tasks"),
        F.coalesce(F.sum(F.when(F.col("locality") == "ANY", F.col("n"))), F.lit(0)).alias("_any"),
        F.array_sort(F.collect_list(item)).alias("_i"),
        *more,
    )
    added = groups.columns[len(keys) + 3 :]
    parts = F.array_join(F.transform("_i", lambda x: x["t"]), " · ")
    line = F.when(F.size("_i") == 0, F.lit("locality -")).otherwise(
        F.concat(F.lit("locality (of "), F.col("tasks").cast("string"), F.lit(" tasks) "), parts)
    )
    return groups.select(
        *keys, "tasks", line.alias("line"),
        (F.col("_any") * 2 > F.greatest(F.col("tasks"), F.lit(1))).alias("mostly_remote"), *added,
    )


def stage_status_rank(status="status"):
    s = F.col(status)
    return F.when(s == "ACTIVE", 0).when(s == "PENDING", 1).when(s == "FAILED", 2).otherwise(3)


def stage_order(stages):
    """Active, pending, failed, rest; newest stage first within each."""
    return stages.withColumn("status_rank", stage_status_rank()).orderBy(
        "app_id", "status_rank", F.desc("stage_id"), F.desc("attempt_id")
    )


def slowest_stages(stages, tasks, measures, n=5):
    """The stages with most task time per app and the metrics they are skewed in."""
    busy = stages.where(F.col("executor_run_time") > 0).withColumn("_rank", stage_status_rank())
    order = [F.desc("executor_run_time"), F.asc("_rank"), F.desc("stage_id"), F.desc("attempt_id")]
    top = top_n(busy, ["app_id"], order, n, ["stage_id", "attempt_id"]).drop("_rank")
    # A few rows per app, known as such once they are written: they are broadcast, and only the tasks of these stages are measured.
    top = written(stages.sparkSession, top, "slowest-stages")
    mine = succeeded(tasks).join(top.select(*STAGE), STAGE, "left_semi")
    return top.join(skew_text(skew(mine, STAGE, measures), STAGE), STAGE, "left")


def job_order(jobs):
    return jobs.orderBy("app_id", F.desc("job_id"))


def job_stages(jobs, bridge, stages):
    """Every job with each of its stages."""
    return jobs.select("app_id", "job_id").join(bridge, ["app_id", "job_id"]).join(stages, ["app_id", "stage_id"])


def stages_of_job(stages, bridge, jobs, job_id=None, needle=""):
    """Stages of one job (or of every job) that match a text filter."""
    picked = jobs if job_id is None else jobs.where(F.col("job_id") == job_id)
    shown = text_filter(with_stage_key(stages), needle, FILTER_FIELDS["stages"])
    return job_stages(picked, bridge, shown)
