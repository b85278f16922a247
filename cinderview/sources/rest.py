"""REST JSON of Spark applications as canonical tables.

A dump is either one file per entity (an array of objects) or JSON lines. All
schemas are fixed and tolerant; missing numbers are 0, missing texts empty
where the table says so.
"""

from pyspark.sql import functions as F

from ..functions.text import iso_ms
from ..operators.threads import frames_of
from ..schemas import REST, as_type


def read_entities(spark, path, entity, multi_line=True):
    """Rows of one entity from dumped REST answers."""
    return (
        spark.read.schema(REST[entity]).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)
    )


def parse_entities(df, entity, col="json"):
    """Rows of one entity from a column that holds a JSON array of objects."""
    fields = F.from_json(F.col(col), f"ARRAY<{as_type(REST[entity])}>")
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.inline(fields))


def _n(name):
    return F.coalesce(F.col(name), F.lit(0))


def _t(name):
    return F.coalesce(F.col(name), F.lit(""))


def _flag(*names):
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(n), F.lit(False))
    return out


def applications(df):
    """One row per listed app, described by its first listed (newest) attempt."""
    first = F.get("attempts", F.lit(0))
    g = lambda f: first.getField(f)
    return df.select(
        F.col("id").alias("app_id"), _t("name").alias("name"),
        F.coalesce(g("sparkUser"), F.lit("")).alias("spark_user"),
        F.coalesce(g("appSparkVersion"), F.lit("")).alias("version"),
        F.coalesce(g("startTime"), F.lit("")).alias("start_time"),
        F.coalesce(g("duration"), F.lit(0)).alias("duration_ms"),
        F.coalesce(g("completed"), F.lit(False)).alias("completed"),
        F.coalesce(F.size("attempts"), F.lit(0)).alias("attempts"),
    )


def jobs(df, *keys):
    return df.select(
        *keys, F.col("jobId").alias("job_id"), _t("name").alias("name"), "description", _t("status").alias("status"),
        "submissionTime", iso_ms("submissionTime").alias("submitted_ms"),
        _n("numTasks").alias("num_tasks"), _n("numActiveTasks").alias("num_active_tasks"),
        _n("numCompletedTasks").alias("num_completed_tasks"), _n("numSkippedTasks").alias("num_skipped_tasks"),
        _n("numFailedTasks").alias("num_failed_tasks"), _n("numCompletedStages").alias("num_completed_stages"),
        _n("numFailedStages").alias("num_failed_stages"),
        F.coalesce("stageIds", F.array().cast("array<bigint>")).alias("stage_ids"),
    )


def job_stages(jobs_df, *keys):
    """Bridge of jobs and their stages."""
    return jobs_df.select(*keys, "job_id", F.explode("stage_ids").alias("stage_id")).distinct()


def stages(df, *keys):
    return df.select(
        *keys, F.col("stageId").alias("stage_id"), _n("attemptId").alias("attempt_id"), _t("name").alias("name"),
        "description", _t("status").alias("status"), F.col("failureReason").alias("failure_reason"),
        _n("numTasks").alias("num_tasks"), _n("numActiveTasks").alias("num_active_tasks"),
        _n("numCompleteTasks").alias("num_complete_tasks"), _n("numFailedTasks").alias("num_failed_tasks"),
        _n("executorRunTime").alias("executor_run_time"), _n("jvmGcTime").alias("jvm_gc_time"),
        _n("inputBytes").alias("input_bytes"), _n("shuffleReadBytes").alias("shuffle_read_bytes"),
        _n("shuffleWriteBytes").alias("shuffle_write_bytes"), _n("memoryBytesSpilled").alias("memory_bytes_spilled"),
        _n("diskBytesSpilled").alias("disk_bytes_spilled"), _t("schedulingPool").alias("scheduling_pool"), "executorSummary",
    )


def stage_executors(stages_df, *keys):
    """Per stage and executor totals from the stage's executor map."""
    e = lambda f: F.coalesce(F.col(f"_e.{f}"), F.lit(0))
    out = stages_df.select(*keys, "stage_id", "attempt_id", F.explode("executorSummary").alias("executor_id", "_e"))
    return out.select(
        *keys, "stage_id", "attempt_id", "executor_id", e("taskTime").alias("task_time"),
        e("succeededTasks").alias("succeeded_tasks"), e("failedTasks").alias("failed_tasks"), e("killedTasks").alias("killed_tasks"),
        e("shuffleRead").alias("shuffle_read"), e("memoryBytesSpilled").alias("memory_bytes_spilled"),
        _flag("_e.isExcludedForStage", "_e.isBlacklistedForStage").alias("is_excluded"),
    )


def tasks(df, *keys):
    m = lambda f: F.coalesce(F.col(f"taskMetrics.{f}"), F.lit(0))
    return df.select(
        *keys, F.col("taskId").alias("task_id"), _n("index").alias("index"), _n("attempt").alias("attempt"),
        _t("executorId").alias("executor_id"), _t("host").alias("host"), _t("status").alias("status"),
        _t("taskLocality").alias("locality"), _flag("speculative").alias("speculative"),
        F.col("errorMessage").alias("error_message"), _n("duration").alias("duration_ms"),
        _n("schedulerDelay").alias("scheduler_delay_ms"), m("executorRunTime").alias("run_time_ms"), m("jvmGcTime").alias("gc_ms"),
        m("memoryBytesSpilled").alias("spill_bytes"), m("diskBytesSpilled").alias("disk_spill_bytes"),
        m("peakExecutionMemory").alias("peak_memory"), m("inputMetrics.bytesRead").alias("input_bytes"),
        (m("shuffleReadMetrics.remoteBytesRead") + m("shuffleReadMetrics.localBytesRead")).alias("shuffle_read_bytes"),
        m("shuffleReadMetrics.fetchWaitTime").alias("fetch_wait_ms"),
        m("shuffleWriteMetrics.bytesWritten").alias("shuffle_write_bytes"),
    )


def executors(df, *keys):
    peak = lambda name: F.try_element_at("peakMemoryMetrics", F.lit(name))
    return df.select(
        *keys, F.col("id").alias("executor_id"), _t("hostPort").alias("host_port"),
        F.coalesce("isActive", F.lit(False)).alias("is_active"), _flag("isExcluded", "isBlacklisted").alias("is_excluded"),
        F.col("removeReason").alias("remove_reason"), iso_ms("addTime").alias("add_ms"), iso_ms("removeTime").alias("remove_ms"),
        _n("totalCores").alias("total_cores"), _n("activeTasks").alias("active_tasks"), _n("failedTasks").alias("failed_tasks"),
        _n("completedTasks").alias("completed_tasks"), _n("memoryUsed").alias("memory_used"), _n("maxMemory").alias("max_memory"),
        _n("diskUsed").alias("disk_used"), _n("totalShuffleRead").alias("total_shuffle_read"),
        _n("totalDuration").alias("total_duration"), _n("totalGCTime").alias("total_gc_time"),
        peak("JVMHeapMemory").alias("peak_heap"), F.coalesce(peak("ProcessTreeJVMRSSMemory"), F.lit(0)).alias("peak_rss"),
        F.coalesce(peak("MajorGCTime"), F.lit(0)).alias("major_gc_ms"), F.coalesce(peak("MinorGCTime"), F.lit(0)).alias("minor_gc_ms"),
        _n("resourceProfileId").alias("resource_profile_id"),
    )


def sql(df, *keys):
    return df.select(
        *keys, F.col("id").alias("execution_id"), _t("status").alias("status"), _t("description").alias("description"),
        F.col("errorMessage").alias("error_message"), _t("submissionTime").alias("submission_time"),
        iso_ms("submissionTime").alias("submitted_ms"), _n("duration").alias("duration_ms"),
        "runningJobIds", "successJobIds", "failedJobIds", "nodes",
    )


def sql_jobs(sql_df, *keys):
    """Bridge of executions and their jobs, with the state the execution lists them in."""
    lists = [("running", "runningJobIds"), ("success", "successJobIds"), ("failed", "failedJobIds")]

    def tag(state, c):
        jobs_of = F.coalesce(F.col(c), F.array().cast("array<bigint>"))
        return F.transform(jobs_of, lambda j: F.struct(F.lit(state).alias("state"), j.alias("job_id")))

    tagged = [tag(state, c) for state, c in lists]
    return sql_df.select(*keys, "execution_id", F.inline(F.concat(*tagged)))


def sql_node_metrics(sql_df, *keys):
    """Plan node metrics in reported order."""
    nodes = sql_df.select(*keys, "execution_id", F.inline("nodes"))
    return nodes.select(
        *keys, "execution_id", F.col("nodeId").alias("node_id"), F.col("nodeName").alias("node_name"),
        F.posexplode("metrics").alias("pos", "_m"),
    ).select(*keys, "execution_id", "node_id", "node_name", "pos", F.col("_m.name").alias("metric"), F.col("_m.value").alias("value"))


def rdds(df, *keys):
    return df.select(
        *keys, F.col("id").alias("rdd_id"), _t("name").alias("name"), _t("storageLevel").alias("storage_level"),
        _n("numPartitions").alias("num_partitions"), _n("numCachedPartitions").alias("num_cached_partitions"),
        _n("memoryUsed").alias("memory_used"), _n("diskUsed").alias("disk_used"),
    )


def rdd_distribution(df, *keys):
    d = df.select(*keys, F.col("id").alias("rdd_id"), F.inline("dataDistribution"))
    return d.select(
        *keys, "rdd_id", "address", _n("memoryUsed").alias("memory_used"), _n("memoryRemaining").alias("memory_remaining"),
        _n("diskUsed").alias("disk_used"),
    )


def rdd_blocks(df, *keys):
    """One row per block and executor that holds it."""
    p = df.select(*keys, F.col("id").alias("rdd_id"), F.explode("partitions").alias("_p"))
    return p.select(
        *keys, "rdd_id", F.col("_p.blockName").alias("block"), _n("_p.memoryUsed").alias("memory_used"),
        _n("_p.diskUsed").alias("disk_used"), F.explode_outer("_p.executors").alias("address"),
    )


def threads(df, *keys):
    """Threads with their frames; the stack comes as an object, an array or a text."""
    stack = F.col("stackTrace")
    wrapped = F.from_json(stack, "elems ARRAY<STRING>").getField("elems")
    listed = F.when(stack.startswith("["), F.from_json(stack, "ARRAY<STRING>"))
    frames = F.coalesce(F.when(stack.startswith("{"), wrapped), listed, frames_of(stack), F.array().cast("array<string>"))
    return df.select(
        *keys, F.col("threadId").alias("thread_id"), _t("threadName").alias("thread_name"), _t("threadState").alias("thread_state"),
        F.col("lockName").alias("lock_name"), F.col("blockedByThreadId").alias("blocked_by_thread_id"),
        F.col("lockOwnerName").alias("lock_owner_name"), F.coalesce("holdingLocks", F.array().cast("array<string>")).alias("holding_locks"),
        frames.alias("frames"),
    )


# Property lists of the environment and the section they fill.
ENV_SECTIONS = [
    ("spark", "sparkProperties"),
    ("hadoop", "hadoopProperties"),
    ("system", "systemProperties"),
    ("metrics", "metricsProperties"),
    ("classpath", "classpathEntries"),
]


def env_properties(df, *keys):
    """Property pairs as rows ``section, key, value``."""

    def tag(section, c):
        pairs = F.coalesce(F.col(c), F.array().cast("array<array<string>>"))
        return F.transform(
            pairs, lambda p: F.struct(F.lit(section).alias("section"), F.get(p, 0).alias("key"), F.get(p, 1).alias("value"))
        )

    tagged = [tag(section, c) for section, c in ENV_SECTIONS]
    return df.select(*keys, F.inline(F.concat(*tagged)))


def resource_profiles(df, *keys):
    p = df.select(*keys, F.explode("resourceProfiles").alias("_p"))
    return p.select(*keys, F.col("_p.id").alias("profile_id"), F.explode("_p.executorResources").alias("resource", "_r")).select(
        *keys, "profile_id", "resource", F.col("_r.amount").alias("amount")
    )


TABLES = {
    "applications": lambda df: applications(df),
    "jobs": jobs,
    "stages": stages,
    "tasks": tasks,
    "executors": executors,
    "sql": sql,
    "rdds": rdds,
    "threads": threads,
    "environment": env_properties,
}


DUMP = ["source", "app_id", "app_attempt", "poll_ts"]


def with_dump_keys(raw, app_id=None):
    """What a dump's path tells about all its rows.

    Folders named ``app_id=``, ``app_attempt=`` and ``poll_ts=`` (epoch millis) say
    it; so does the folder below ``applications`` (the attempt is the number below
    it). Else the app is the folder the dump is in, unless it is given, the attempt
    is null, and the poll is when the file was written, which a copy changes.
    """
    path = F.col("_metadata.file_path")
    part = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    named = lambda key: part(f"/{key}=([^/]+)/")
    app = F.coalesce(named("app_id"), part("/applications/([^/]+)/"), part("([^/]+)/[^/]*$"))
    return raw.withColumns({
        "source": path,
        "app_id": app if app_id is None else F.lit(app_id),
        "app_attempt": F.coalesce(named("app_attempt"), part(r"/applications/[^/]+/(\d+)/")).try_cast("int"),
        "poll_ts": F.coalesce(named("poll_ts").try_cast("long"), F.unix_millis(F.col("_metadata.file_modification_time"))),
    })


def read_snapshot(spark, path, table, multi_line=True, app_id=None):
    """A canonical table from dumped REST JSON, with the keys of :func:`with_dump_keys`."""
    raw = read_entities(spark, path, table, multi_line)
    if table == "applications":
        return applications(raw)
    return TABLES[table](with_dump_keys(raw, app_id), *DUMP)


# Lists that a combined snapshot object holds.
COMBINED = ["jobs", "stages", "executors", "sql", "rdds"]


def read_combined(spark, path, app_id=None):
    """Canonical tables from dumps that hold all lists of a poll in one object; missing lists are empty."""
    schema = ", ".join(f"{name} ARRAY<{as_type(REST[name])}>" for name in COMBINED)
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    raw = with_dump_keys(raw, app_id)
    return {name: TABLES[name](raw.select(*DUMP, F.inline(name)), *DUMP) for name in COMBINED}


def read_threads(spark, path):
    return read_snapshot(spark, path, "threads")


def read_environment(spark, path, multi_line=True, app_id=None):
    """Property rows and resource profile rows of dumped environments, with the keys of :func:`with_dump_keys`."""
    raw = with_dump_keys(read_entities(spark, path, "environment", multi_line), app_id)
    return {"env_properties": env_properties(raw, *DUMP), "resource_profiles": resource_profiles(raw, *DUMP)}
