"""Thread dumps: who is blocked, by whom, and what is worth reading first."""

from pyspark.sql import functions as F

from ..functions.text import lines_of, trimmed

SPARK_FRAME = "org.apache.spark"
# Thread groups in reading order.
GROUPS = ["BLOCKED", "WAITING ON LOCK", "RUNNABLE", "IDLE / OTHER"]


def frames_of(stack_text):
    """Frames of a stack given as text: trimmed lines without blanks."""
    return F.filter(F.transform(lines_of(stack_text), trimmed), lambda f: f != "")


def with_frames(threads, stack="stack_text"):
    return threads.withColumn("frames", F.coalesce(frames_of(stack), F.array().cast("array<string>")))


def thread_groups(threads):
    """Blocked, waiting on a lock, runnable, idle; threads in Spark code first in each."""
    state = F.col("thread_state")
    locked = F.col("lock_name").isNotNull() | F.col("blocked_by_thread_id").isNotNull()
    rank = (
        F.when(state == "BLOCKED", 1)
        .when(state.isin("WAITING", "TIMED_WAITING") & locked, 2)
        .when(state == "RUNNABLE", 3)
        .otherwise(4)
    )
    named = F.element_at(F.array(*[F.lit(g) for g in GROUPS]), F.col("group_rank"))
    return (
        threads.withColumn("group_rank", rank)
        .withColumn("group", named)
        .withColumn("spark_work", F.exists("frames", lambda f: f.startswith(SPARK_FRAME)))
        .orderBy("app_id", "executor_id", "group_rank", F.desc("spark_work"), "thread_name", "thread_id")
    )


def lock_chain(threads, keys=("app_id", "executor_id")):
    """Blocked threads with the thread that holds their lock, and the locks both hold themselves."""
    keys = list(keys)
    held = F.coalesce(F.col("holding_locks"), F.array().cast("array<string>"))
    owners = threads.select(
        *keys, F.col("thread_id").alias("blocked_by_thread_id"), F.col("thread_name").alias("owner_name"),
        F.col("thread_state").alias("owner_state"), held.alias("owner_holding_locks"),
    )
    blocked = threads.where(F.col("blocked_by_thread_id").isNotNull()).withColumn("holding_locks", held)
    return blocked.join(owners, [*keys, "blocked_by_thread_id"], "left")
