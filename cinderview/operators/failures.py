"""One deduplicated failure log per application, from every poll of its telemetry.

Inputs carry ``app_id`` and ``poll`` (a number that grows with time). A
failure keeps the title of its first sighting and the first detail text that
ever came with it, which may arrive in a later poll.
"""

from pyspark.sql import functions as F

from ..functions.ordered import carried, top_n, union_all
from ..functions.text import detail_line, title_of

# Order of failure kinds within one poll.
KIND_ORDER = {"stage": 0, "job": 1, "executor": 2, "sql": 3, "task": 4}
# Order columns of a failure: first poll, kind, place within the kind, text key.
SEQ = ["first_poll", "kind_order", "place", "sub", "key"]

POLL = ["app_id", "poll"]


def _text(*parts):
    """Concatenate columns and literals; nulls make the result null."""
    return F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])


def failed_stage_of_job(job_stages, stages, keys=("app_id",)):
    """Newest failed stage of each job with its reason.

    Failed stages are few next to the bridge, so they are filtered first.
    """
    keys = list(keys)
    failed = stages.where(F.col("status") == "FAILED").select(*keys, "stage_id", "attempt_id", "failure_reason")
    newest = F.max_by(
        F.struct("stage_id", "attempt_id", "failure_reason"), F.struct("stage_id", "attempt_id")
    )
    on = [k for k in keys if k in job_stages.columns] + ["stage_id"]
    return (
        job_stages.join(failed, on)
        .groupBy(*keys, "job_id")
        .agg(newest.alias("_s"))
        .select(*keys, "job_id", "_s.stage_id", "_s.attempt_id", "_s.failure_reason")
    )


def sql_errors(sql, sql_jobs, job_stages, stages, keys=("app_id",)):
    """Error of each failed execution: its own text, else the reason of its newest failed stage."""
    keys = list(keys)
    on = [k for k in keys if k in sql_jobs.columns]
    failed_jobs = sql_jobs.where(F.col("state") == "failed").select(*on, "execution_id", "job_id")
    stage = failed_stage_of_job(job_stages, stages, keys)
    per_sql = (
        failed_jobs.join(stage, [*on, "job_id"])
        .groupBy(*keys, "execution_id")
        .agg(
            F.max_by(
                F.struct("stage_id", "attempt_id", "failure_reason"), F.struct("stage_id", "attempt_id")
            ).alias("_s")
        )
    )
    own = F.when(F.regexp_like(F.col("error_message"), F.lit(r"\S")), F.col("error_message"))
    from_stage = _text("stage ", F.col("_s.stage_id"), ".", F.col("_s.attempt_id"), ": ", F.col("_s.failure_reason"))
    failed = sql.where(F.col("status") == "FAILED")
    return failed.join(per_sql, [*keys, "execution_id"], "left").select(
        *[F.col(c) for c in failed.columns],
        F.coalesce(own, from_stage).alias("error"),
        F.col("_s.stage_id").alias("failed_stage_id"),
        F.col("_s.attempt_id").alias("failed_attempt_id"),
    )


def _sightings(df, kind, key, title, detail, place, sub=0, stage=(None, None), executor=None):
    null = lambda t: F.lit(None).cast(t)
    stage_id, attempt_id = stage
    return df.select(
        "app_id",
        F.col("poll").cast("long").alias("poll"),
        key.alias("key"),
        F.lit(kind).alias("kind"),
        F.lit(KIND_ORDER[kind]).alias("kind_order"),
        place.cast("long").alias("place"),
        F.lit(sub).alias("sub"),
        title.alias("title"),
        detail.alias("detail"),
        (null("long") if stage_id is None else stage_id).alias("stage_id"),
        (null("long") if attempt_id is None else attempt_id).alias("attempt_id"),
        (null("string") if executor is None else executor).alias("executor_id"),
    )


def failure_sightings(stages=None, jobs=None, job_stages=None, executors=None, sql=None, sql_jobs=None, tasks=None):
    """Every failure seen in every poll, as one table (a union of the kinds)."""
    parts = []
    if stages is not None:
        st = stages.where(F.col("status") == "FAILED")
        sid, aid = F.col("stage_id"), F.col("attempt_id")
        parts.append(
            _sightings(
                st, "stage", _text("stage:", sid, ".", aid),
                _text("Stage ", sid, ".", aid, " failed · ", F.col("name")),
                F.col("failure_reason"), -sid, stage=(sid, aid),
            )
        )
    if jobs is not None:
        reason = failed_stage_of_job(job_stages, stages, POLL)
        sizes = job_stages.groupBy("app_id", "job_id").agg(F.count(F.lit(1)).alias("_stages"))
        j = (
            jobs.where(F.col("status") == "FAILED")
            .join(reason, [*POLL, "job_id"], "left")
            .join(sizes, ["app_id", "job_id"], "left")
        )
        counts = _text(
            F.col("num_failed_stages"), " of ", F.coalesce("_stages", F.lit(0)), " stages failed, ",
            F.col("num_failed_tasks"), " tasks failed",
        )
        why = _text("\nstage ", F.col("stage_id"), ".", F.col("attempt_id"), ": ", F.col("failure_reason"))
        parts.append(
            _sightings(
                j, "job", _text("job:", F.col("job_id")),
                _text("Job #", F.col("job_id"), " failed · ", F.col("name")),
                F.concat(counts, F.coalesce(why, F.lit(""))), -F.col("job_id"),
                stage=(F.col("stage_id"), F.col("attempt_id")),
            )
        )
    if executors is not None:
        ex = F.col("executor_id")
        lost = executors.where(~F.col("is_active") & F.col("remove_reason").isNotNull())
        parts.append(
            _sightings(
                lost, "executor", _text("exec:", ex, ":removed"),
                _text("Executor ", ex, " lost · ", F.col("host_port")),
                F.col("remove_reason"), F.lit(0), 0, executor=ex,
            )
        )
        out = executors.where(F.col("is_excluded"))
        parts.append(
            _sightings(
                out, "executor", _text("exec:", ex, ":excluded"),
                _text("Executor ", ex, " excluded · ", F.col("host_port")),
                _text(
                    "Excluded by the scheduler after ", F.col("failed_tasks"),
                    " failed tasks; no new tasks will be scheduled on it.",
                ),
                F.lit(0), 1, executor=ex,
            )
        )
    if sql is not None:
        q = sql_errors(sql, sql_jobs, job_stages, stages, POLL)
        parts.append(
            _sightings(
                q, "sql", _text("sql:", F.col("execution_id")),
                _text("Query #", F.col("execution_id"), " failed · ", title_of("description")),
                F.col("error"), -F.col("execution_id"),
                stage=(F.col("failed_stage_id"), F.col("failed_attempt_id")),
            )
        )
    if tasks is not None:
        t = tasks.where(F.col("status") == "FAILED")
        parts.append(
            _sightings(
                t, "task", _text("task:", F.col("task_id"), ".", F.col("attempt")),
                _text(
                    "Task ", F.col("task_id"), ".", F.col("attempt"), " failed · stage ", F.col("stage_id"), ".",
                    F.col("attempt_id"), " · executor ", F.col("executor_id"), " (", F.col("host"), ")",
                ),
                F.col("error_message"), F.col("task_id"),
                stage=(F.col("stage_id"), F.col("attempt_id")), executor=F.col("executor_id"),
            )
        )
    return union_all(parts)


def dedup_failures(sightings):
    """One row per (app, key): first title, first detail that is not null.

    A plain aggregate, so every map task combines before the shuffle.
    """
    seq = F.struct("poll", "kind_order", "place", "sub", "title", F.coalesce("executor_id", F.lit("")))
    # Attributes that are fixed by the first sighting travel together.
    first = F.min_by(F.struct("kind", "kind_order", "place", "sub", "title", "stage_id", "attempt_id", "executor_id"), seq)
    return (
        sightings.groupBy("app_id", "key")
        .agg(
            F.min("poll").alias("first_poll"),
            first.alias("_f"),
            F.min_by("detail", F.when(F.col("detail").isNotNull(), seq)).alias("detail"),
        )
        .select("app_id", "key", "first_poll", "_f.*", "detail")
    )


def failure_log(**tables):
    return dedup_failures(failure_sightings(**tables))


def numbered(failures, name="seq"):
    """Position of each failure in its app's log, counted from 1.

    Counted in chunks of the order, so one busy app is spread over tasks.
    """
    chunked = failures.withColumn("_place_chunk", F.floor(F.col("place") / 65536))
    return carried(
        chunked, ["app_id"], ["first_poll", "kind_order", "_place_chunk"],
        ["first_poll", "kind_order", "place", "sub", "key"], total={name: F.lit(1)},
    ).drop("_place_chunk")


def unacked(failures, ack_seq):
    """Failures after the acknowledged position (a number, or a column)."""
    return failures.where(F.col("seq") > ack_seq)


def unacked_summary(failures, ack_seq):
    """How many failures nobody looked at, and the latest of them."""
    return (
        unacked(failures, ack_seq)
        .groupBy("app_id")
        .agg(F.count(F.lit(1)).alias("unacked"), F.max_by("title", "seq").alias("latest_title"))
    )


def failures_by_kind(failures):
    return failures.groupBy("app_id", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("app_id", "kind")


def top_reasons(failures, n=5):
    """The most common first detail lines per app, with the newest failure's title."""
    reason = detail_line(F.coalesce("detail", F.lit("")))
    counted = (
        failures.withColumn("reason", reason)
        .where(F.col("reason") != "")
        .groupBy("app_id", "reason")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by("title", F.struct(*SEQ)).alias("example"))
    )
    return top_n(counted, ["app_id"], [F.desc("n"), F.asc("reason")], n, ["reason"])


def failure_growth(stages, max_stages=None):
    """Stages whose failed-task count rose since the last poll that listed them.

    ``max_stages`` keeps the newest stages per poll, as a live monitor would.
    """
    chunked = stages.withColumn("_chunk", F.floor(F.col("poll") / 4096))
    seen = carried(
        chunked, ["app_id", "stage_id", "attempt_id"], ["_chunk"], ["poll"],
        lag={"previous": F.col("num_failed_tasks")},
    ).drop("_chunk")
    grown = seen.withColumn("previous", F.coalesce("previous", F.lit(0))).where(
        F.col("num_failed_tasks") > F.col("previous")
    )
    if max_stages is None:
        return grown
    order = [F.desc("stage_id"), F.desc("attempt_id")]
    return top_n(grown, POLL, order, max_stages, ["stage_id", "attempt_id"]).drop("rank")


def removal_reasons(executors):
    """Lost executors per first line of their removal reason."""
    reason = F.nullif(detail_line(F.coalesce("remove_reason", F.lit(""))), F.lit(""))
    return (
        executors.where(~F.col("is_active"))
        .groupBy("app_id", F.coalesce(reason, F.lit("no reason reported")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("executors"))
    )
