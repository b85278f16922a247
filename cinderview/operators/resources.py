"""Executors, their memory budgets, and cached data."""

from pyspark.sql import functions as F

from ..functions.ordered import spread_join, union_all
from ..functions.text import fixed, percent, share

MIB = 1024 * 1024
RESERVED = 300 * MIB
DEFAULT_FRACTION = 0.6
# Bands of used over available memory.
WARN_SHARE, HIGH_SHARE, LOW_HEAP = 0.75, 0.9, 0.8


def executor_state(executors, as_of_ms):
    """dead / excluded / up, whether the executor is gone, and its age at ``as_of_ms``."""
    since = F.coalesce("remove_ms", "add_ms")
    return executors.withColumn(
        "state", F.when(~F.col("is_active"), "dead").when(F.col("is_excluded"), "excluded").otherwise("up")
    ).withColumn("gone", F.col("remove_ms").isNotNull()).withColumn(
        "age_ms", F.greatest(F.lit(as_of_ms) - since, F.lit(0))
    )


def cluster_totals(jobs, executors):
    """Job and executor totals per app: cores over active executors, the rest over all."""
    j = jobs.groupBy("app_id").agg(
        F.count_if(F.col("status") == "RUNNING").alias("jobs_running"),
        F.count_if(F.col("status") == "FAILED").alias("jobs_failed"),
        F.count(F.lit(1)).alias("jobs_total"),
    )
    e = executors.groupBy("app_id").agg(
        F.count_if("is_active").alias("executors_active"),
        F.count(F.lit(1)).alias("executors_total"),
        F.coalesce(F.sum(F.when(F.col("is_active"), F.col("total_cores"))), F.lit(0)).alias("cores"),
        F.sum("active_tasks").alias("active_tasks"),
        F.sum("memory_used").alias("memory_used"),
        F.sum("max_memory").alias("max_memory"),
        F.sum("total_shuffle_read").alias("shuffle_read"),
        F.sum("total_gc_time").alias("_gc"),
        F.sum("total_duration").alias("_run"),
    )
    gc = percent("_gc", "_run")
    out = j.join(e, "app_id", "full_outer")
    zero = [c for c in out.columns if c not in ("app_id", "_gc", "_run")]
    return (
        out.fillna(0, zero)
        .withColumn("gc_percent", F.coalesce(gc, F.lit(0.0)))
        .withColumn("gc_hot", F.col("gc_percent") > 10)
        .drop("_gc", "_run")
    )


def gc_share(executors):
    """Percent of task time in garbage collection, for executors that ran tasks."""
    return executors.where(F.col("total_duration") > 0).withColumn(
        "gc_percent", F.lit(100.0) * F.col("total_gc_time") / F.col("total_duration")
    )


def worst_gc(executors, above=10.0):
    """Per app the executor with most collection time, where that is above 10 %."""
    worst = F.min_by(
        F.struct("executor_id", "gc_percent"), F.struct((-F.col("gc_percent")).alias("p"), F.col("executor_id"))
    )
    return (
        gc_share(executors)
        .groupBy("app_id")
        .agg(worst.alias("_w"), F.count(F.lit(1)).alias("of"))
        .select("app_id", "_w.*", "of")
        .where(F.col("gc_percent") > above)
    )


def storage_totals(executors):
    """Storage memory and disk per app, and its fullest executor (last wins a tie)."""
    ratio = share("memory_used", "max_memory")
    with_ratio = executors.withColumn("_ratio", ratio)
    order = F.when(F.col("max_memory") > 0, F.struct("_ratio", "executor_id"))
    return (
        with_ratio.groupBy("app_id")
        .agg(
            F.sum("memory_used").alias("memory_used"),
            F.sum("max_memory").alias("max_memory"),
            F.sum("disk_used").alias("disk_used"),
            F.max_by(F.struct(F.col("executor_id").alias("fullest"), F.col("_ratio").alias("fullest_ratio")), order).alias("_f"),
        )
        .withColumn("used_percent", percent("memory_used", "max_memory"))
        .withColumn("red", F.col("used_percent") > 90)
        .select("app_id", "memory_used", "max_memory", "disk_used", "used_percent", "red", "_f.fullest", "_f.fullest_ratio")
    )


def cache_summary(rdds):
    """Cached data per app and how much of it is only partly cached."""
    partial = F.col("num_cached_partitions") < F.col("num_partitions")
    return rdds.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("cached"),
        F.sum("memory_used").alias("memory_used"),
        F.sum("disk_used").alias("disk_used"),
        F.count_if(partial).alias("partly_cached"),
    )


def cached_ratio(rdds):
    return rdds.withColumn("cached_ratio", share("num_cached_partitions", "num_partitions"))


def rdd_order(rdds):
    return rdds.withColumn("stored", F.col("memory_used") + F.col("disk_used")).orderBy("app_id", F.desc("stored"), "rdd_id")


def rdd_partition_summary(blocks):
    """Blocks listed, blocks on disk and the largest block of each cached dataset."""
    size = F.col("memory_used") + F.col("disk_used")
    return (
        blocks.groupBy("app_id", "rdd_id")
        .agg(
            F.count(F.lit(1)).alias("partitions"),
            F.count_if(F.col("disk_used") > 0).alias("on_disk"),
            F.max_by(F.struct(F.col("block").alias("largest"), size.alias("largest_bytes")), F.struct(size.alias("s"), F.col("block"))).alias("_l"),
        )
        .select("app_id", "rdd_id", "partitions", "on_disk", "_l.*")
    )


def rdd_spread(distribution, blocks):
    """Where a cached dataset lies: per executor its blocks, share and fill.

    ``distribution`` has ``address, memory_used, memory_remaining, disk_used``.
    """
    held = blocks.groupBy("app_id", "rdd_id", "address").agg(F.count(F.lit(1)).alias("partitions"))
    total = distribution.groupBy("app_id", "rdd_id").agg(F.sum("memory_used").alias("_total"))
    capacity = F.col("memory_used") + F.col("memory_remaining")
    fill = F.when(capacity > 0, F.col("memory_used") / F.nullif(capacity, F.lit(0))).otherwise(F.lit(0.0))
    return (
        distribution.join(held, ["app_id", "rdd_id", "address"], "left")
        .join(total, ["app_id", "rdd_id"])
        .withColumn("share", F.col("memory_used") / F.greatest(F.col("_total"), F.lit(1)))
        .withColumn("fill", fill)
        .drop("_total")
    )


def executor_budget(executors, profiles, env):
    """Memory budget of each executor from its resource profile (MiB) and the settings."""
    amount = lambda name: F.max(F.when(F.col("resource") == name, F.col("amount"))) * MIB
    budget = profiles.groupBy("app_id", F.col("profile_id").alias("resource_profile_id")).agg(
        amount("memory").alias("heap"), amount("memoryOverhead").alias("overhead"), amount("offHeap").alias("off_heap")
    )
    setting = F.when(
        (F.col("section") == "spark") & (F.col("key") == "spark.memory.fraction"), F.col("value")
    )
    fraction = env.groupBy("app_id").agg(F.max(setting).try_cast("double").alias("_fraction"))
    with_budget = spread_join(executors, budget, ["app_id", "resource_profile_id"], ["executor_id"], "left")
    return (
        spread_join(with_budget, fraction, ["app_id"], ["executor_id"], "left")
        .withColumn("fraction", F.coalesce("_fraction", F.lit(DEFAULT_FRACTION)))
        .withColumn(
            "container", F.col("heap") + F.coalesce("overhead", F.lit(0)) + F.coalesce("off_heap", F.lit(0))
        )
        .drop("_fraction")
    )


def _ratio(part, whole):
    return F.when(F.col(whole) > 0, F.col(part) / F.nullif(F.col(whole), F.lit(0)))


def heap_pressure(budgeted, high=HIGH_SHARE):
    """Executors whose peak heap came within 10 % of their heap budget."""
    return budgeted.withColumn("heap_ratio", _ratio("peak_heap", "heap")).where(F.col("heap_ratio") >= high)


def heap_pressure_line(bytes_text):
    return F.concat(
        F.lit("executor "), F.col("executor_id"), F.lit(": peak heap "), bytes_text("peak_heap"), F.lit(" is "),
        fixed(F.col("heap_ratio") * 100, 0), F.lit("% of spark.executor.memory"),
    )


def band(ratio):
    """ok / warn / high of a used share."""
    return F.when(ratio >= HIGH_SHARE, "high").when(ratio >= WARN_SHARE, "warn").when(ratio.isNotNull(), "ok")


def memory_verdict(budgeted):
    """Which memory fills up: ``overhead``, ``heap`` or neither."""
    heap_r, rss_r = _ratio("peak_heap", "heap"), _ratio("peak_rss", "container")
    verdict = (
        F.when(F.col("heap").isNull(), F.lit(None).cast("string"))
        .when((F.col("peak_rss") > 0) & (rss_r >= HIGH_SHARE) & (heap_r < LOW_HEAP), "overhead")
        .when(heap_r >= HIGH_SHARE, "heap")
        .otherwise("ok")
    )
    unified = F.floor(F.greatest(F.col("heap") - RESERVED, F.lit(0)) * F.col("fraction")).cast("long")
    return (
        budgeted.withColumn("heap_ratio", heap_r)
        .withColumn("rss_ratio", rss_r)
        .withColumn("verdict", verdict)
        .withColumn("unified_budget", unified)
        .withColumn("heap_band", band(heap_r))
        .withColumn("rss_band", band(rss_r))
        .withColumn("gc_ms", F.col("major_gc_ms") + F.col("minor_gc_ms"))
    )


def threshold_flags(executors, budgeted, stages, rdds):
    """Every signal of an app that is over its threshold, one row each."""
    flags = lambda df, subject, signal, level: df.select(
        "app_id", subject.cast("string").alias("subject"), F.lit(signal).alias("signal"), level.alias("level")
    )
    verdict = memory_verdict(budgeted)
    fill = percent("memory_used", "max_memory")
    parts = [
        flags(verdict.where(F.col("heap_band").isin("warn", "high")), F.col("executor_id"), "heap", F.col("heap_band")),
        flags(verdict.where(F.col("rss_band").isin("warn", "high")), F.col("executor_id"), "rss", F.col("rss_band")),
        flags(gc_share(executors).where(F.col("gc_percent") > 10), F.col("executor_id"), "gc", F.lit("high")),
        flags(executors.where(fill > 90), F.col("executor_id"), "storage", F.lit("high")),
        flags(stages.where(F.col("memory_bytes_spilled") > 0), F.col("stage_id"), "spill", F.lit("warn")),
        flags(
            rdds.where(F.col("num_cached_partitions") < F.col("num_partitions")), F.col("rdd_id"), "partial cache", F.lit("warn")
        ),
    ]
    return union_all(parts)
