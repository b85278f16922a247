"""Micro-batches of streaming queries: runs, merged history, statistics.

Progress rows carry ``app_id, query_id, name, run_id, batch_id, arrival,
started_ms, num_input_rows, input_rps, processed_rps, trigger_ms`` and what
else a query reports. Rows from SQL executions carry ``execution_id, status,
submitted_ms, duration_ms`` with the same ids.
"""

from pyspark.sql import functions as F

from ..functions.ordered import order_statistics, spread_join, top_n, union_all
from ..functions.text import batch_fields, display_name, title_of

QUERY = ["app_id", "query_id"]
RUN = ["app_id", "query_id", "run_id"]
BATCH = ["app_id", "query_id", "run_id", "batch_id"]
BEHIND_WINDOW, BEHIND_MIN = 5, 3
LOG_MARGIN_MS = 1000


def with_batch(df, description="description"):
    """Rows whose description names a micro-batch, with its ids (and ``query_name``)."""
    parsed = df.withColumn("_b", batch_fields(description)).where(F.col("_b").isNotNull())
    return parsed.select(
        *[F.col(c) for c in df.columns], F.col("_b.query_id").alias("query_id"), F.col("_b.run_id").alias("run_id"),
        F.col("_b.batch_id").alias("batch_id"), F.col("_b.name").alias("query_name"),
    ).drop("_b")


def current_runs(rows, order, name="name"):
    """The live run of each query: ``app_id, query_id, run_id, name``.

    A query id is live when no other id with its name arrived first later;
    within the id the run whose first row came last is live. One aggregate
    over the rows; the rest works on one row per run.
    """
    runs = rows.groupBy(*RUN).agg(F.min(order).alias("_first"), F.max(F.nullif(F.col(name), F.lit(""))).alias("name"))
    ids = runs.groupBy(*QUERY).agg(
        F.min("_first").alias("_first"),
        F.max_by("run_id", F.struct("_first", "run_id")).alias("run_id"),
        F.max("name").alias("name"),
    )
    return (
        ids.withColumn("_named", F.col("name").isNotNull())
        .withColumn("_who", F.coalesce("name", "query_id"))
        .groupBy("app_id", "_named", "_who")
        .agg(F.max_by(F.struct("query_id", "run_id", "name"), F.struct("_first", "query_id")).alias("_q"))
        .select("app_id", "_q.*")
    )


def current_run(rows, order, name="name"):
    """Rows of live runs only; replays of older ids and runs are left out."""
    return spread_join(rows, current_runs(rows, order, name).select(*RUN), RUN, [order, "batch_id"], "left_semi")


def retired_ids(rows, order, name="name"):
    """Query ids that another id with the same name replaced."""
    seen = rows.select(*QUERY).distinct()
    return seen.join(current_runs(rows, order, name).select(*QUERY), QUERY, "left_anti")


def merge_batches(progress, sql):
    """One row per live micro-batch from progress rows and SQL executions.

    The first progress of a batch wins; status and submission come from its
    last execution (a missing submission does not overwrite one). Progress
    decides the duration when there is any.
    """
    arrivals = progress.select(*RUN, "name", F.col("started_ms").alias("_at")).unionByName(
        sql.select(*RUN, "name", F.col("submitted_ms").alias("_at"))
    )
    live = current_runs(arrivals, "_at")
    facts = [c for c in progress.columns if c not in (*BATCH, "name", "arrival")]
    p = (
        progress.groupBy(*BATCH)
        .agg(F.min_by(F.struct(*facts), F.struct("arrival", "started_ms")).alias("_p"))
        .select(*BATCH, "_p.*", F.lit(True).alias("has_progress"))
    )
    s = sql.groupBy(*BATCH).agg(
        F.max_by("status", "execution_id").alias("status"),
        F.max_by("submitted_ms", F.when(F.col("submitted_ms").isNotNull(), F.col("execution_id"))).alias("submitted_ms"),
        F.max_by("duration_ms", "execution_id").alias("sql_duration_ms"),
        F.max("execution_id").alias("execution_id"),
    )
    return (
        p.join(s, BATCH, "full_outer")
        .join(live, RUN)
        .withColumn("has_progress", F.coalesce("has_progress", F.lit(False)))
        .withColumn("duration_ms", F.when(F.col("has_progress"), F.col("trigger_ms")).otherwise(F.col("sql_duration_ms")))
        .drop("sql_duration_ms")
    )


def batch_keys(progress, sql):
    """Batches known from either source."""
    return progress.select(*BATCH).union(sql.select(*BATCH)).distinct()


def retain_batches(batches, keep=None):
    """The newest ``keep`` batches of each query, as a live view shows them; None keeps all."""
    if keep is None:
        return batches
    return top_n(batches, QUERY, [F.desc("batch_id")], keep, ["batch_id"]).drop("rank")


def batch_stats(kept):
    """Mean (truncated), p95 and maximum trigger time per query."""
    took = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    sized = kept.groupBy(*QUERY).agg(
        F.count(F.lit(1)).alias("batches"), F.count(took).alias("_n"), F.sum(took).alias("_sum"), F.max(took).alias("_max")
    )
    rank = lambda n: F.floor((n - 1) * F.lit(0.95) + F.lit(0.5))
    p95 = order_statistics(kept.where(F.col("duration_ms") > 0), QUERY, {"d": "duration_ms"}, {"p95": rank})
    return sized.join(p95.select(*QUERY, "p95"), QUERY, "left").select(
        *QUERY,
        "batches",
        F.when(F.col("_n") > 0, F.call_function("div", F.col("_sum"), F.col("_n"))).otherwise(F.lit(0)).cast("long").alias("mean_ms"),
        F.coalesce(F.col("p95").cast("long"), F.lit(0)).alias("p95_ms"),
        F.coalesce("_max", F.lit(0)).alias("max_ms"),
    )


def query_snapshot(kept):
    """Where each query stands: latest batch and progress, state, lag, pace."""
    seen = F.when(F.col("has_progress"), F.col("batch_id"))
    dated = F.when(F.col("started_ms").isNotNull(), F.col("batch_id"))
    latest = F.max_by(
        F.struct("input_rps", "processed_rps", "state_rows", "state_bytes", "started_ms", "watermark_ms"), seen
    )
    rows = kept.groupBy(*QUERY).agg(
        F.max("batch_id").alias("latest_batch"),
        F.max_by("duration_ms", "batch_id").alias("latest_ms"),
        latest.alias("_p"),
        F.count("started_ms").alias("_n"),
        F.min_by("started_ms", dated).alias("_first"),
        F.max_by("started_ms", dated).alias("_last"),
    )
    span = F.col("_last") - F.col("_first")
    pace = F.when(
        (F.col("_n") > 1) & (span > 0), (F.col("_n") - 1) * F.lit(60000.0) / F.nullif(span.cast("double"), F.lit(0.0))
    ).otherwise(F.lit(0.0))
    return rows.select(
        *QUERY, "latest_batch", "latest_ms",
        F.coalesce("_p.input_rps", F.lit(0.0)).alias("input_rps"),
        F.coalesce("_p.processed_rps", F.lit(0.0)).alias("processed_rps"),
        F.coalesce("_p.state_rows", F.lit(0)).alias("state_rows"),
        F.coalesce("_p.state_bytes", F.lit(0)).alias("state_bytes"),
        (F.col("_p.started_ms") - F.col("_p.watermark_ms")).alias("watermark_lag_ms"),
        pace.alias("batches_per_min"),
    )


def behind_batch(rows="num_input_rows", inp="input_rps", proc="processed_rps"):
    return (F.col(rows) > 0) & (F.col(proc) < F.col(inp))


def falling_behind(df, keys, order, rows="num_input_rows", inp="input_rps", proc="processed_rps"):
    """Whether at least 3 of a query's last 5 batches with progress (and input) were slow."""
    last = top_n(df, keys, [F.desc(order)], BEHIND_WINDOW, [order])
    return last.groupBy(*keys).agg(
        F.count_if(F.col(rows) > 0).alias("with_input"),
        F.count_if(behind_batch(rows, inp, proc)).alias("slow"),
    ).withColumn("behind", (F.col("with_input") >= BEHIND_MIN) & (F.col("slow") >= BEHIND_MIN))


def failed_batches(kept):
    return kept.groupBy(*QUERY).agg(F.count_if(F.col("status") == "FAILED").alias("failed"))


def dropped_rows(kept, dropped="rows_dropped"):
    """Rows dropped by the watermark, per batch and over the kept batches."""
    total = kept.groupBy(*QUERY).agg(F.coalesce(F.sum(F.greatest(F.col(dropped), F.lit(0))), F.lit(0)).alias("window_dropped"))
    return kept.join(total, QUERY).select(*QUERY, "batch_id", F.greatest(F.col(dropped), F.lit(0)).alias("dropped"), "window_dropped")


def phase_columns(phases="phases"):
    """Time in ``addBatch`` and in everything else of a batch, from its phase map."""
    work = F.greatest(F.coalesce(F.try_element_at(F.col(phases), F.lit("addBatch")), F.lit(0)), F.lit(0))
    rest = F.map_filter(phases, lambda k, v: ~k.isin("addBatch", "triggerExecution"))
    overhead = F.aggregate(F.map_values(rest), F.lit(0).cast("long"), lambda a, v: a + F.greatest(v, F.lit(0)))
    return work.alias("add_batch_ms"), overhead.alias("overhead_ms")


def phase_series(progress, phases="phases"):
    """Chart points of each batch, oldest first."""
    lag = F.greatest(F.coalesce(F.col("started_ms") - F.col("watermark_ms"), F.lit(0)), F.lit(0))
    rate = lambda c: F.round(F.greatest(F.col(c), F.lit(0.0))).cast("long")
    return progress.select(
        *QUERY, "batch_id", *phase_columns(phases), lag.alias("lag_ms"),
        F.greatest(F.col("rows_dropped"), F.lit(0)).alias("dropped"),
        F.greatest(F.col("state_rows"), F.lit(0)).alias("state_rows"),
        rate("input_rps").alias("input_rate"), rate("processed_rps").alias("processed_rate"),
    ).orderBy(*QUERY, "batch_id")


def overhead_hot(series):
    """Queries whose last batch spent more time around the work than on it."""
    last = series.groupBy(*QUERY).agg(
        F.max_by("overhead_ms", "batch_id").alias("overhead_ms"), F.max_by("add_batch_ms", "batch_id").alias("add_batch_ms")
    )
    return last.withColumn("hot", (F.col("overhead_ms") > F.col("add_batch_ms")) & (F.col("overhead_ms") > 0))


def slow_batches(kept, stats):
    """Each batch against its query's p95 and mean."""
    mean = F.when(F.col("mean_ms") > 0, F.col("duration_ms") / F.nullif(F.col("mean_ms"), F.lit(0))).otherwise(F.lit(0.0))
    return (
        kept.join(stats.drop("batches"), QUERY)
        .withColumn("slow", (F.col("p95_ms") > 0) & (F.col("duration_ms") > F.col("p95_ms")))
        .withColumn("vs_mean", mean)
    )


def slowest_batches(kept, n=3):
    return top_n(kept, QUERY, [F.desc("duration_ms"), F.asc("batch_id")], n, ["batch_id"])


def query_label():
    return F.coalesce("name", F.substring("query_id", 1, 8))


def batch_order(batches):
    """Queries by label, newest batch first in each."""
    return batches.withColumn("label", query_label()).orderBy("app_id", "label", "query_id", F.desc("batch_id"))


def query_order(batches):
    """Queries of an app by label."""
    queries = batches.groupBy(*QUERY).agg(F.max("name").alias("name"))
    return queries.withColumn("label", query_label()).orderBy("app_id", "label", "query_id")


def batch_window():
    """Log window of a batch: ``[start - 1 s, start + duration + 1 s]``, null when undated."""
    start = F.when(F.col("has_progress"), F.col("started_ms")).otherwise(F.col("submitted_ms"))
    length = F.when(F.col("has_progress"), F.greatest("trigger_ms", "duration_ms")).otherwise(F.col("duration_ms"))
    length = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))
    return (start - LOG_MARGIN_MS).alias("from_ms"), (start + length + LOG_MARGIN_MS).alias("to_ms")


def with_window(batches):
    start, end = batch_window()
    return batches.withColumn("from_ms", start).withColumn("to_ms", end)


def log_read_from(sql, as_of_ms=None, keep=None, back_ms=None):
    """Where log reading has to start so that every batch is covered.

    A live view may look at the newest ``keep`` executions of each query only,
    and at most ``back_ms`` before ``as_of_ms``; by default all count.
    """
    timed = sql.where(F.col("submitted_ms").isNotNull())
    if keep is not None:
        timed = top_n(timed, QUERY, [F.desc("submitted_ms"), F.desc("execution_id")], keep, ["execution_id"])
    start = F.min("submitted_ms") - LOG_MARGIN_MS
    start = start if back_ms is None else F.greatest(start, F.lit(as_of_ms) - back_ms)
    return timed.groupBy("app_id").agg(start.alias("read_from_ms"))


def batch_jobs(jobs):
    """Jobs and failed jobs of each micro-batch, from job descriptions."""
    return with_batch(jobs).groupBy(*BATCH).agg(
        F.max("query_name").alias("name"),
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_jobs"),
    )


def batch_stage_ids(jobs, job_stages, batches):
    """Distinct stages of the jobs of each listed batch."""
    mine = with_batch(jobs).select("app_id", "job_id", "run_id", "batch_id")
    listed = batches.select(*BATCH).distinct()
    return (
        mine.join(listed, ["app_id", "run_id", "batch_id"])
        .join(job_stages, ["app_id", "job_id"])
        .select("app_id", "query_id", "batch_id", "stage_id")
        .dropDuplicates()
    )


def batch_stages(jobs, job_stages, stages, batches):
    """Stages that ran for each listed micro-batch."""
    return batch_stage_ids(jobs, job_stages, batches).join(stages, ["app_id", "stage_id"])


def batch_failures(failures, jobs, job_stages, sql, batches, staged=None):
    """Failures of each listed micro-batch: of its stages, its jobs, or its execution.

    Failures are looked up by key and by stage in one join, so what they are made
    of is read once. ``staged`` is :func:`batch_stage_ids` where it is there already.
    """
    ids = ["app_id", "query_id", "batch_id"]
    listed = batches.select(*BATCH).distinct()
    by = lambda df, prefix, id_col: with_batch(df).join(listed, ["app_id", "run_id", "batch_id"]).select(
        "app_id", listed["query_id"], "batch_id", F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("key")
    )
    if staged is None:
        staged = batch_stage_ids(jobs, job_stages, batches)
    at = lambda what, of: F.struct(F.lit(what).alias("what"), F.col(of).cast("string").alias("id"))
    of_batches = union_all([
        by(jobs, "job:", "job_id").select(*ids, at("key", "key").alias("_at")),
        by(sql, "sql:", "execution_id").select(*ids, at("key", "key").alias("_at")),
        staged.select(*ids, at("stage", "stage_id").alias("_at")),
    ])
    places = F.array_compact(F.array(at("key", "key"), F.when(F.col("stage_id").isNotNull(), at("stage", "stage_id"))))
    known = failures.select("app_id", "key", F.explode(places).alias("_at"))
    return known.join(of_batches, ["app_id", "_at"]).select(*ids, "key").dropDuplicates()


def job_labels(sql, sql_jobs):
    """``sql #id · title`` per job; the lowest execution id wins."""
    hint = F.concat(
        F.lit("sql #"), F.col("execution_id").cast("string"), F.lit(" · "),
        display_name(title_of("description"), "description"),
    )
    return (
        sql.select("app_id", "execution_id", hint.alias("label"))
        .join(sql_jobs.select("app_id", "execution_id", "job_id"), ["app_id", "execution_id"])
        .groupBy("app_id", "job_id")
        .agg(F.min_by("label", "execution_id").alias("label"))
    )


def stage_labels(labels, job_stages):
    """Label of the newest labelled job of each stage."""
    return (
        labels.join(job_stages, ["app_id", "job_id"])
        .groupBy("app_id", "stage_id")
        .agg(F.max_by("label", "job_id").alias("label"))
    )


def restarted_queries(*described):
    """Query names seen with more than one run id in job or stage descriptions."""
    runs = union_all([with_batch(d.select("app_id", "description")).select("app_id", "query_name", "run_id") for d in described])
    return (
        runs.where(F.col("query_name").isNotNull())
        .dropDuplicates()
        .groupBy("app_id", "query_name")
        .agg(F.count(F.lit(1)).alias("runs"))
        .where(F.col("runs") > 1)
    )


def named_rows(df, labels, restarted, on):
    """Rows with their display name and, for restarted queries, the run."""
    described = (
        df.join(labels, on, "left")
        .withColumn("_b", batch_fields("description"))
        .withColumn("_run", F.col("_b.run_id"))
        .withColumn("_qn", F.col("_b.name"))
    )
    again = restarted.select("app_id", F.col("query_name").alias("_qn"), F.lit(True).alias("_again"))
    described = spread_join(described, again, ["app_id", "_qn"], on, "left")
    base = display_name("name", "description", F.col("label"))
    run = F.when(F.col("_again"), F.concat(F.lit(" · run "), F.substring("_run", 1, 8)))
    return described.withColumn("display_name", F.concat(base, F.coalesce(run, F.lit("")))).drop(
        "_b", "_run", "_qn", "_again", "label"
    )
