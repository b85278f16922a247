"""Text filters over fixed field lists."""

from pyspark.sql import functions as F

from .ordered import any_of, spread_join

# Fields each table is searched in.
FILTER_FIELDS = {
    "jobs": ["job_id", "status", "name"],
    "stages": ["stage_key", "status", "name"],
    "executors": ["executor_id", "host_port", "state", "remove_reason"],
    "sql": ["execution_id", "status", "description", "error_message"],
    "failures": ["kind", "title", "detail"],
    "rdds": ["rdd_id", "name", "storage_level"],
}


def text_match(needle, cols):
    """Case-insensitive substring over columns; blank needles match every row."""
    wanted = (needle or "").strip().lower()
    if not wanted:
        return F.lit(True)
    return any_of(
        [F.coalesce(F.lower(F.col(x).cast("string")).contains(wanted), F.lit(False)) for x in cols]
    )


def text_filter(df, needle, cols):
    return df.where(text_match(needle, cols))


def with_stage_key(stages):
    return stages.withColumn(
        "stage_key", F.concat(F.col("stage_id").cast("string"), F.lit("."), F.col("attempt_id").cast("string"))
    )


def with_executor_state(executors):
    return executors.withColumn(
        "state",
        F.when(~F.col("is_active"), "dead").when(F.col("is_excluded"), "excluded").otherwise("up"),
    )


def filtered_counts(df, needle, cols, keys=()):
    """Rows shown and rows in total."""
    shown = F.sum(F.when(text_match(needle, cols), 1).otherwise(0))
    return df.groupBy(*keys).agg(shown.cast("long").alias("shown"), F.count(F.lit(1)).alias("total"))


def env_search(env, needle):
    """Property rows whose key or value match, with the hits of their section."""
    hits = text_filter(env, needle, ["key", "value"])
    counts = hits.groupBy("app_id", "section").agg(F.count(F.lit(1)).alias("section_hits"))
    return spread_join(hits, counts, ["app_id", "section"], ["key", "value"])


def thread_filter(threads, needle):
    wanted = needle.strip().lower()
    return threads.where(
        F.lower("thread_name").contains(wanted)
        | F.exists("frames", lambda f: F.lower(f).contains(wanted))
    )


def metric_filter(metrics, needle):
    return text_filter(metrics, needle, ["key", "source"])


def log_grep(lines, needle):
    return text_filter(lines, needle, ["line"])
