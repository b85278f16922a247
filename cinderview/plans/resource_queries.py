"""Queries over samples, executors, caches, threads, settings and the registry."""

from pyspark.sql import functions as F

from ..functions import filters
from ..operators import rates, registry as reg, resources as res, settings, threads as th
from .registry import query

AS_OF = 1704070800000


@query("task_rate", """
WITH d AS (SELECT *, lag(poll_s) OVER w AS pt, lag(completed_tasks) OVER w AS pc FROM fx_samples WINDOW w AS (PARTITION BY app_id ORDER BY poll_s)),
r AS (SELECT *, CASE WHEN pt IS NOT NULL THEN round(10.0 * CAST(greatest(completed_tasks - pc, 0) AS DOUBLE)
             / greatest(CAST(poll_s - pt AS DOUBLE), CAST(0.001 AS DOUBLE))) / 10 END AS rate FROM d)
SELECT app_id, CAST(max_by(rate, CASE WHEN rate IS NOT NULL THEN poll_s END) AS DOUBLE) AS now_rate, CAST(max(rate) AS DOUBLE) AS peak_rate,
       max_by(active_tasks, poll_s) AS now_active, max(active_tasks) AS peak_active
FROM r GROUP BY app_id""")
def task_rate(v):
    return rates.task_rate(v.fx_samples)


@query("executor_churn", """
SELECT app_id, max_by(alive_executors, poll_s) AS now_alive, max(alive_executors) AS peak_alive,
       greatest(max_by(removed_executors, poll_s) - min_by(removed_executors, poll_s), 0) AS removed_in_window
FROM fx_samples GROUP BY app_id""")
def executor_churn(v):
    return rates.executor_churn(v.fx_samples)


_RATE = """
rated AS (SELECT *, CASE WHEN poll_s - lag(poll_s) OVER w > 0
            THEN (value - lag(value) OVER w) / CAST(poll_s - lag(poll_s) OVER w AS DOUBLE) END AS rate
          FROM fx_metrics WINDOW w AS (PARTITION BY app_id, key ORDER BY poll_s))"""


@query("counter_rate", f"WITH {_RATE} SELECT app_id, key, poll_s, value, rate FROM rated")
def counter_rate(v):
    return rates.counter_rate(v.fx_metrics, ["app_id", "key"], "poll_s", "value").select(
        "app_id", "key", "poll_s", "value", "rate"
    )


@query("counter_prev", """
SELECT app_id, key, poll_s, value, lag(poll_s) OVER w AS prev_poll_s, lag(value) OVER w AS prev_value
FROM fx_metrics WINDOW w AS (PARTITION BY app_id, key ORDER BY poll_s)""")
def counter_prev(v):
    seen = rates.with_previous(v.fx_metrics, ["app_id", "key"], "poll_s", ["value"])
    return seen.select("app_id", "key", "poll_s", "value", "prev_poll_s", "prev_value")


@query("metric_series", f"""WITH {_RATE}
SELECT app_id, key, poll_s, CASE kind WHEN 'gauge' THEN value WHEN 'counter' THEN rate WHEN 'meter' THEN m1_rate ELSE mean END AS point FROM rated""")
def metric_series(v):
    return rates.metric_series(v.fx_metrics).select("app_id", "key", "poll_s", "point")


@query("last_samples", """
SELECT app_id, poll_s, completed_tasks, active_tasks FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY poll_s DESC) AS rn
FROM fx_samples) s WHERE rn <= 120""")
def last_samples(v):
    return rates.last_samples(v.fx_samples, 120).select("app_id", "poll_s", "completed_tasks", "active_tasks")


@query("metric_sources", "SELECT app_id, poll_s, source, count(*) AS metrics FROM fx_metrics GROUP BY app_id, poll_s, source")
def metric_sources(v):
    return reg.metric_sources(v.fx_metrics, ["app_id", "poll_s"])


@query("metric_order", """
SELECT app_id, poll_s, key, source, name, CAST(CASE source WHEN 'LiveListenerBus' THEN 1 WHEN 'DAGScheduler' THEN 2 WHEN 'JVMCPUTime' THEN 5
  ELSE 0 END AS BIGINT) AS source_rank FROM fx_metrics""")
def metric_order(v):
    return reg.metric_order(v.fx_metrics).select("app_id", "poll_s", "key", "source", "name", F.col("source_rank").cast("long"))


@query("metric_filter", "SELECT app_id, poll_s, key FROM fx_metrics WHERE contains(lower(key), 'stream') OR contains(lower(source), 'stream')")
def metric_filter(v):
    return filters.metric_filter(v.fx_metrics, "Stream").select("app_id", "poll_s", "key")


def _num(x):
    """SQL text of a metric number."""
    return (
        f"CASE WHEN abs({x}) >= 1e12 THEN printf('%.2fT', ({x}) / 1e12) WHEN abs({x}) >= 1e9 THEN printf('%.2fG', ({x}) / 1e9) "
        f"WHEN abs({x}) >= 1e6 THEN printf('%.2fM', ({x}) / 1e6) WHEN abs({x}) >= 1e4 THEN printf('%.1fk', ({x}) / 1e3) "
        f"WHEN {x} = floor({x}) THEN printf('%.0f', {x}) WHEN abs({x}) >= 10 THEN printf('%.1f', {x}) ELSE printf('%.2f', {x}) END"
    )


# The registry of one poll, with every number the health rows read.
_HEALTH_METRICS = """
SELECT app_id, poll_s, key, source, name, kind, CASE WHEN key = 'JVMCPUTime.jvmCpuTime' THEN value * 1e9 ELSE value END AS value,
       value * 3 AS p95, mean, value AS max FROM fx_metrics
UNION ALL SELECT app_id, poll_s, 'DAGScheduler.stage.runningStages', 'DAGScheduler', 'stage.runningStages', 'gauge', value, 0.0, 0.0, 0.0 FROM fx_metrics WHERE source = 'shop'
UNION ALL SELECT app_id, poll_s, 'DAGScheduler.stage.failedStages', 'DAGScheduler', 'stage.failedStages', 'gauge', m1_rate - 2, 0.0, 0.0, 0.0 FROM fx_metrics WHERE source = 'shop'
UNION ALL SELECT app_id, poll_s, 'BlockManager.memory.memUsed_MB', 'BlockManager', 'memory.memUsed_MB', 'gauge', value, 0.0, 0.0, 0.0 FROM fx_metrics WHERE source = 'shop'
UNION ALL SELECT app_id, poll_s, 'BlockManager.memory.remainingMem_MB', 'BlockManager', 'memory.remainingMem_MB', 'gauge', m1_rate, 0.0, 0.0, 0.0 FROM fx_metrics WHERE source = 'shop'
UNION ALL SELECT app_id, poll_s, 'CodeGenerator.compilationTime', 'CodeGenerator', 'compilationTime', 'histogram', value, 0.0, mean, value FROM fx_metrics WHERE source = 'LiveListenerBus'"""


@query("driver_health", f"""
WITH m AS ({_HEALTH_METRICS}),
cpu AS (SELECT app_id, poll_s, CASE WHEN poll_s - lag(poll_s) OVER w > 0 THEN (value - lag(value) OVER w) / CAST(poll_s - lag(poll_s) OVER w AS DOUBLE) END AS rate
        FROM m WHERE key = 'JVMCPUTime.jvmCpuTime' WINDOW w AS (PARTITION BY app_id ORDER BY poll_s)),
pick AS (SELECT app_id, poll_s, max(CASE WHEN key = 'DAGScheduler.stage.runningStages' THEN value END) AS running,
                max(CASE WHEN key = 'DAGScheduler.stage.failedStages' THEN value END) AS failed,
                max(CASE WHEN key = 'BlockManager.memory.memUsed_MB' THEN value END) AS used,
                max(CASE WHEN key = 'BlockManager.memory.remainingMem_MB' THEN value END) AS remaining
         FROM m GROUP BY app_id, poll_s)
SELECT app_id, poll_s, 1 AS ord, 'listener events dropped' AS label,
       CASE WHEN value > 0 THEN {_num('value')} || ' — the UI/REST API has missed events; raise spark.scheduler.listenerbus.eventqueue.capacity' ELSE '0' END AS value,
       value > 0 AS warn FROM m WHERE source = 'LiveListenerBus'
UNION ALL SELECT app_id, poll_s, 2, 'scheduler message time p95', {_num('p95')} || 'ms', p95 > 1000 FROM m WHERE key = 'DAGScheduler.messageProcessingTime'
UNION ALL SELECT app_id, poll_s, 3, 'stages running / waiting / failed', {_num('running')} || ' / 0 / ' || {_num('failed')}, failed > 0 FROM pick WHERE running IS NOT NULL
UNION ALL SELECT app_id, poll_s, 4, 'block manager memory', {_num('used')} || ' of ' || {_num('(used + remaining)')} || ' MiB (' || printf('%.0f', 100 * used / (used + remaining)) || '%)',
       100 * used / (used + remaining) >= 90 FROM pick WHERE used IS NOT NULL
UNION ALL SELECT app_id, poll_s, 5, 'codegen compile', {_num('value')} || ' compilations · mean ' || {_num('mean')} || 'ms · max ' || {_num('max')} || 'ms', FALSE
       FROM m WHERE key = 'CodeGenerator.compilationTime'
UNION ALL SELECT app_id, poll_s, 6, 'driver CPU', printf('%.2f', rate / 1e9) || ' cores', FALSE FROM cpu WHERE rate IS NOT NULL""")
def driver_health(v):
    return reg.driver_health(v.sql(_HEALTH_METRICS))


@query("metric_text", f"""WITH {_RATE}
SELECT app_id, key, poll_s, {_num('value')} AS headline,
       CASE kind WHEN 'gauge' THEN '' WHEN 'counter' THEN coalesce(CASE WHEN rate IS NOT NULL THEN {_num('rate')} || '/s since last poll' END, '')
            WHEN 'meter' THEN {_num('m1_rate')} || '/s (1m) · 0/s (5m) · ' || {_num('mean')} || '/s mean'
            ELSE 'mean ' || {_num('mean')} || 'ms · p50 0ms · p95 ' || {_num('(value * 3)')} || 'ms · max ' || {_num('value')} || 'ms · ' || {_num('m1_rate')} || '/s' END AS detail
FROM rated""")
def metric_text(v):
    rated = rates.counter_rate(v.fx_metrics, ["app_id", "key"], "poll_s", "value")
    full = (
        rated.withColumn("text", F.lit(None).cast("string"))
        .withColumn("units", F.lit("milliseconds"))
        .withColumn("m5_rate", F.lit(None).cast("double"))
        .withColumn("mean_rate", F.col("mean"))
        .withColumn("p50", F.lit(0.0))
        .withColumn("p95", F.col("value") * 3)
        .withColumn("max", F.col("value"))
    )
    return full.select("app_id", "key", "poll_s", *reg.metric_text("rate"))


@query("executor_state", f"""
SELECT app_id, executor_id, CASE WHEN NOT is_active THEN 'dead' WHEN is_excluded THEN 'excluded' ELSE 'up' END AS state,
       remove_ms IS NOT NULL AS gone, greatest({AS_OF} - coalesce(remove_ms, add_ms), 0) AS age_ms FROM fx_executors""")
def executor_state(v):
    return res.executor_state(v.fx_executors, AS_OF).select("app_id", "executor_id", "state", "gone", "age_ms")


@query("cluster_totals", """
WITH j AS (SELECT app_id, CAST(sum(CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END) AS BIGINT) AS jobs_running,
                  CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS jobs_failed, count(*) AS jobs_total FROM fx_jobs GROUP BY app_id),
e AS (SELECT app_id, CAST(sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT) AS executors_active, count(*) AS executors_total,
             CAST(sum(CASE WHEN is_active THEN total_cores ELSE 0 END) AS BIGINT) AS cores, CAST(sum(active_tasks) AS BIGINT) AS active_tasks,
             CAST(sum(memory_used) AS BIGINT) AS memory_used, CAST(sum(max_memory) AS BIGINT) AS max_memory,
             CAST(sum(total_shuffle_read) AS BIGINT) AS shuffle_read, CAST(100.0 AS DOUBLE) * CAST(sum(total_gc_time) AS DOUBLE) / CAST(sum(total_duration) AS DOUBLE) AS gc_percent
      FROM fx_executors GROUP BY app_id)
SELECT j.*, e.* EXCLUDE (app_id), e.gc_percent > 10 AS gc_hot FROM j JOIN e ON j.app_id = e.app_id""")
def cluster_totals(v):
    return res.cluster_totals(v.fx_jobs, v.fx_executors)


@query("gc_share", """
SELECT app_id, executor_id, CAST(100.0 AS DOUBLE) * total_gc_time / total_duration AS gc_percent FROM fx_executors WHERE total_duration > 0""")
def gc_share(v):
    return res.gc_share(v.fx_executors).select("app_id", "executor_id", "gc_percent")


_WORST_GC = """
worst_gc AS (
  SELECT app_id, executor_id, gc_percent, of FROM (
    SELECT app_id, executor_id, CAST(100.0 AS DOUBLE) * total_gc_time / total_duration AS gc_percent, count(*) OVER (PARTITION BY app_id) AS of,
           row_number() OVER (PARTITION BY app_id ORDER BY CAST(100.0 AS DOUBLE) * total_gc_time / total_duration DESC, executor_id) AS rn
    FROM fx_executors WHERE total_duration > 0) g WHERE rn = 1 AND gc_percent > 10)"""


@query("worst_gc", f"WITH {_WORST_GC} SELECT * FROM worst_gc")
def worst_gc(v):
    return res.worst_gc(v.fx_executors)


@query("storage_totals", """
WITH r AS (SELECT *, least(greatest(CAST(memory_used AS DOUBLE) / max_memory, 0), 1) AS ratio FROM fx_executors)
SELECT app_id, CAST(sum(memory_used) AS BIGINT) AS memory_used, CAST(sum(max_memory) AS BIGINT) AS max_memory,
       CAST(sum(disk_used) AS BIGINT) AS disk_used, CAST(100.0 AS DOUBLE) * CAST(sum(memory_used) AS DOUBLE) / CAST(sum(max_memory) AS DOUBLE) AS used_percent,
       CAST(100.0 AS DOUBLE) * CAST(sum(memory_used) AS DOUBLE) / CAST(sum(max_memory) AS DOUBLE) > 90 AS red,
       max_by(executor_id, row(ratio, executor_id)) AS fullest, max(ratio) AS fullest_ratio
FROM r GROUP BY app_id""")
def storage_totals(v):
    return res.storage_totals(v.fx_executors)


@query("cache_summary", """
SELECT app_id, count(*) AS cached, CAST(sum(memory_used) AS BIGINT) AS memory_used, CAST(sum(disk_used) AS BIGINT) AS disk_used,
       CAST(sum(CASE WHEN num_cached_partitions < num_partitions THEN 1 ELSE 0 END) AS BIGINT) AS partly_cached FROM fx_rdds GROUP BY app_id""")
def cache_summary(v):
    return res.cache_summary(v.fx_rdds)


@query("rdd_order", "SELECT app_id, rdd_id, memory_used + disk_used AS stored, CAST(num_cached_partitions AS DOUBLE) / num_partitions AS cached_ratio FROM fx_rdds")
def rdd_order(v):
    return res.rdd_order(res.cached_ratio(v.fx_rdds)).select("app_id", "rdd_id", "stored", "cached_ratio")


@query("rdd_partitions_summary", """
SELECT app_id, rdd_id, count(*) AS partitions, CAST(sum(CASE WHEN disk_used > 0 THEN 1 ELSE 0 END) AS BIGINT) AS on_disk,
       max_by(block, row(memory_used + disk_used, block)) AS largest, max(memory_used + disk_used) AS largest_bytes
FROM fx_rdd_blocks GROUP BY app_id, rdd_id""")
def rdd_partitions_summary(v):
    return res.rdd_partition_summary(v.fx_rdd_blocks)


# Stored bytes per dataset and executor; a third of the executors listed hold nothing.
_DISTRIBUTION = """
SELECT app_id, rdd_id, address, CAST(sum(memory_used) AS BIGINT) AS memory_used,
       CAST(sum(memory_used) * (rdd_id % 3) AS BIGINT) AS memory_remaining, CAST(sum(disk_used) AS BIGINT) AS disk_used
FROM fx_rdd_blocks GROUP BY app_id, rdd_id, address
UNION ALL SELECT DISTINCT app_id, rdd_id, 'driver', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM fx_rdd_blocks"""


@query("rdd_spread", f"""
WITH d AS ({_DISTRIBUTION}),
h AS (SELECT app_id, rdd_id, address, count(*) AS partitions FROM fx_rdd_blocks GROUP BY app_id, rdd_id, address)
SELECT d.*, h.partitions, CAST(d.memory_used AS DOUBLE) / greatest(sum(d.memory_used) OVER (PARTITION BY d.app_id, d.rdd_id), 1) AS share,
       CASE WHEN d.memory_used + d.memory_remaining > 0 THEN CAST(d.memory_used AS DOUBLE) / (d.memory_used + d.memory_remaining) ELSE 0 END AS fill
FROM d LEFT JOIN h ON d.app_id = h.app_id AND d.rdd_id = h.rdd_id AND d.address = h.address""")
def rdd_spread(v):
    return res.rdd_spread(v.sql(_DISTRIBUTION), v.fx_rdd_blocks)


_BUDGET = """
budget AS (
  SELECT e.*, p.heap, p.overhead, p.off_heap, coalesce(f.fraction, CAST(0.6 AS DOUBLE)) AS fraction,
         p.heap + coalesce(p.overhead, 0) + coalesce(p.off_heap, 0) AS container
  FROM fx_executors e
  LEFT JOIN (SELECT app_id, profile_id, max(CASE WHEN resource = 'memory' THEN amount END) * 1048576 AS heap,
                    max(CASE WHEN resource = 'memoryOverhead' THEN amount END) * 1048576 AS overhead,
                    max(CASE WHEN resource = 'offHeap' THEN amount END) * 1048576 AS off_heap
             FROM fx_profiles GROUP BY app_id, profile_id) p ON e.app_id = p.app_id AND e.resource_profile_id = p.profile_id
  LEFT JOIN (SELECT app_id, CAST(max(value) AS DOUBLE) AS fraction FROM fx_env WHERE section = 'spark' AND key = 'spark.memory.fraction'
             GROUP BY app_id) f ON e.app_id = f.app_id)"""


def budgeted(v):
    return res.executor_budget(v.fx_executors, v.fx_profiles, v.fx_env)


@query("executor_budget", f"WITH {_BUDGET} SELECT app_id, executor_id, heap, overhead, off_heap, container, fraction FROM budget")
def executor_budget(v):
    return budgeted(v).select("app_id", "executor_id", "heap", "overhead", "off_heap", "container", "fraction")


@query("heap_pressure", f"""WITH {_BUDGET}
SELECT app_id, executor_id, CAST(peak_heap AS DOUBLE) / heap AS heap_ratio FROM budget WHERE CAST(peak_heap AS DOUBLE) / heap >= 0.9""")
def heap_pressure(v):
    return res.heap_pressure(budgeted(v)).select("app_id", "executor_id", "heap_ratio")


_VERDICT = _BUDGET + """,
ratios AS (SELECT *, CAST(peak_heap AS DOUBLE) / heap AS heap_ratio, CAST(peak_rss AS DOUBLE) / container AS rss_ratio FROM budget),
verdicts AS (
  SELECT *, CASE WHEN heap IS NULL THEN NULL WHEN peak_rss > 0 AND rss_ratio >= 0.9 AND heap_ratio < 0.8 THEN 'overhead'
                 WHEN heap_ratio >= 0.9 THEN 'heap' ELSE 'ok' END AS verdict,
         CAST(floor(greatest(heap - 314572800, 0) * fraction) AS BIGINT) AS unified_budget,
         CASE WHEN heap_ratio >= 0.9 THEN 'high' WHEN heap_ratio >= 0.75 THEN 'warn' WHEN heap_ratio IS NOT NULL THEN 'ok' END AS heap_band,
         CASE WHEN rss_ratio >= 0.9 THEN 'high' WHEN rss_ratio >= 0.75 THEN 'warn' WHEN rss_ratio IS NOT NULL THEN 'ok' END AS rss_band,
         major_gc_ms + minor_gc_ms AS gc_ms FROM ratios)"""


@query("memory_verdict", f"WITH {_VERDICT} SELECT app_id, executor_id, heap_ratio, rss_ratio, verdict, unified_budget, heap_band, rss_band, gc_ms FROM verdicts")
def memory_verdict(v):
    return res.memory_verdict(budgeted(v)).select(
        "app_id", "executor_id", "heap_ratio", "rss_ratio", "verdict", "unified_budget", "heap_band", "rss_band", "gc_ms"
    )


@query("threshold_flags", f"""WITH {_VERDICT}
SELECT app_id, executor_id AS subject, 'heap' AS signal, heap_band AS level FROM verdicts WHERE heap_band IN ('warn', 'high')
UNION ALL SELECT app_id, executor_id, 'rss', rss_band FROM verdicts WHERE rss_band IN ('warn', 'high')
UNION ALL SELECT app_id, executor_id, 'gc', 'high' FROM fx_executors WHERE total_duration > 0 AND CAST(100.0 AS DOUBLE) * total_gc_time / total_duration > 10
UNION ALL SELECT app_id, executor_id, 'storage', 'high' FROM fx_executors WHERE CAST(100.0 AS DOUBLE) * memory_used / max_memory > 90
UNION ALL SELECT app_id, CAST(stage_id AS STRING), 'spill', 'warn' FROM fx_stages WHERE memory_bytes_spilled > 0
UNION ALL SELECT app_id, CAST(rdd_id AS STRING), 'partial cache', 'warn' FROM fx_rdds WHERE num_cached_partitions < num_partitions""")
def threshold_flags(v):
    return res.threshold_flags(v.fx_executors, budgeted(v), v.fx_stages, v.fx_rdds)


_FRAMES = """
framed AS (SELECT *, list_filter(list_transform(string_split(stack_text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS frames FROM fx_threads)"""


@query("thread_groups", f"""WITH {_FRAMES},
grouped AS (SELECT *, CASE WHEN thread_state = 'BLOCKED' THEN 1 WHEN thread_state IN ('WAITING', 'TIMED_WAITING')
                 AND (lock_name IS NOT NULL OR blocked_by_thread_id IS NOT NULL) THEN 2 WHEN thread_state = 'RUNNABLE' THEN 3 ELSE 4 END AS group_rank FROM framed)
SELECT app_id, executor_id, thread_id, group_rank, CASE group_rank WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'WAITING ON LOCK' WHEN 3 THEN 'RUNNABLE' ELSE 'IDLE / OTHER' END AS "group",
       len(list_filter(frames, lambda x: starts_with(x, 'org.apache.spark'))) > 0 AS spark_work FROM grouped""")
def thread_groups(v):
    return th.thread_groups(th.with_frames(v.fx_threads)).select(
        "app_id", "executor_id", "thread_id", "group_rank", "group", "spark_work"
    )


@query("thread_filter", f"""WITH {_FRAMES}
SELECT app_id, executor_id, thread_id FROM framed WHERE contains(lower(thread_name), 'the') OR len(list_filter(frames, lambda x: contains(lower(x), 'the'))) > 0""")
def thread_filter(v):
    return filters.thread_filter(th.with_frames(v.fx_threads), "The").select("app_id", "executor_id", "thread_id")


@query("lock_chain", """
SELECT t.app_id, t.executor_id, t.thread_id, t.thread_name, t.lock_name, t.blocked_by_thread_id, o.thread_name AS owner_name, o.thread_state AS owner_state,
       coalesce(array_to_string(t.holding_locks, ','), '') AS holds, CASE WHEN o.thread_id IS NOT NULL THEN coalesce(array_to_string(o.holding_locks, ','), '') END AS owner_holds
FROM fx_threads t LEFT JOIN fx_threads o ON t.app_id = o.app_id AND t.executor_id = o.executor_id AND t.blocked_by_thread_id = o.thread_id
WHERE t.blocked_by_thread_id IS NOT NULL""")
def lock_chain(v):
    return th.lock_chain(v.fx_threads).select(
        "app_id", "executor_id", "thread_id", "thread_name", "lock_name", "blocked_by_thread_id", "owner_name", "owner_state",
        F.array_join("holding_locks", ",").alias("holds"), F.array_join("owner_holding_locks", ",").alias("owner_holds"),
    )


@query("env_search", """
WITH h AS (SELECT * FROM fx_env WHERE contains(lower(key), 'auto') OR contains(lower(value), 'auto'))
SELECT *, count(*) OVER (PARTITION BY app_id, section) AS section_hits FROM h""")
def env_search(v):
    return filters.env_search(v.fx_env, "Auto")


@query("key_settings", """
SELECT app_id, key, min(value) AS value, CAST(CASE key WHEN 'spark.executor.memory' THEN 1 WHEN 'spark.memory.fraction' THEN 7 ELSE 22 END AS BIGINT) AS place
FROM fx_env WHERE section = 'spark' AND key IN ('spark.executor.memory', 'spark.memory.fraction', 'spark.serializer') GROUP BY app_id, key""")
def key_settings(v):
    return settings.key_settings(v.fx_env)


@query("node_top_metrics", """
WITH first_of AS (SELECT app_id, execution_id, node_id, metric, min(pos) AS pos, min_by(value, pos) AS value FROM fx_nodes GROUP BY app_id, execution_id, node_id, metric),
ranked AS (SELECT *, CASE WHEN contains(metric, 'number of output rows') THEN 1 WHEN contains(metric, 'spill size') THEN 2 WHEN contains(metric, 'peak memory') THEN 3
                          WHEN contains(metric, 'time') THEN 4 WHEN contains(metric, 'duration') THEN 5 WHEN contains(metric, 'bytes') THEN 6
                          WHEN contains(metric, 'size of files') THEN 7 WHEN contains(metric, 'number of partitions') THEN 8 ELSE 9 END AS pref FROM first_of)
SELECT app_id, execution_id, node_id, metric, value, rank, contains(metric, 'spill') AND NOT starts_with(value, '0.0 B') AND NOT starts_with(value, '0') AS hot FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY app_id, execution_id, node_id ORDER BY pref, pos) AS BIGINT) AS rank FROM ranked) r WHERE rank <= 3""")
def node_top_metrics(v):
    return settings.node_top_metrics(v.fx_nodes)


@query("sql_upsert", """
WITH seen AS (SELECT app_id, execution_id, job_id AS poll, status FROM fx_jobs),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id, execution_id ORDER BY poll DESC) AS rn FROM seen) s WHERE rn = 1)
SELECT app_id, execution_id, poll, status FROM latest""")
def sql_upsert(v):
    seen = v.fx_jobs.select("app_id", "execution_id", F.col("job_id").alias("poll"), "status")
    return settings.upsert_latest(seen, ["app_id"], "execution_id", "poll")
