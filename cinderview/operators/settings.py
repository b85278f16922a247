"""Settings, plan-node metrics and merged re-reads."""

from pyspark.sql import functions as F

from ..functions.ordered import top_n

# The settings that decide most performance questions, in order.
KEY_SETTINGS = [
    "spark.executor.memory",
    "spark.executor.memoryOverhead",
    "spark.executor.cores",
    "spark.executor.instances",
    "spark.memory.offHeap.enabled",
    "spark.memory.offHeap.size",
    "spark.memory.fraction",
    "spark.driver.memory",
    "spark.driver.cores",
    "spark.sql.shuffle.partitions",
    "spark.default.parallelism",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.dynamicAllocation.enabled",
    "spark.dynamicAllocation.minExecutors",
    "spark.dynamicAllocation.maxExecutors",
    "spark.sql.streaming.checkpointLocation",
    "spark.sql.streaming.stateStore.providerClass",
    "spark.eventLog.enabled",
    "spark.eventLog.dir",
    "spark.serializer",
    "spark.speculation",
    "spark.kubernetes.executor.deleteOnTermination",
]
# Parts of plan-metric names worth showing, most useful first.
NODE_METRICS = [
    "number of output rows",
    "spill size",
    "peak memory",
    "time",
    "duration",
    "bytes",
    "size of files",
    "number of partitions",
]


def key_settings(env):
    """The pinned settings an app has, in list order."""
    pinned = env.where((F.col("section") == "spark") & F.col("key").isin(KEY_SETTINGS))
    place = F.array_position(F.array(*[F.lit(k) for k in KEY_SETTINGS]), F.col("key")).cast("long")
    return (
        pinned.groupBy("app_id", "key")
        .agg(F.min("value").alias("value"))
        .withColumn("place", place)
        .orderBy("app_id", "place")
    )


def node_top_metrics(nodes, n=3):
    """The ``n`` most useful metrics of each plan node; a name shows once."""
    keys = ["app_id", "execution_id", "node_id"]
    first = nodes.groupBy(*keys, "metric").agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value"))
    choice = F.lit(len(NODE_METRICS) + 1)
    for i in range(len(NODE_METRICS) - 1, -1, -1):
        choice = F.when(F.col("metric").contains(NODE_METRICS[i]), F.lit(i + 1)).otherwise(choice)
    top = top_n(first.withColumn("_choice", choice), keys, [F.asc("_choice"), F.asc("pos")], n, ["metric"])
    value = F.col("value")
    hot = F.col("metric").contains("spill") & ~value.startswith("0.0 B") & ~value.startswith("0")
    return top.select(*keys, "metric", "value", "rank", hot.alias("hot"))


def upsert_latest(df, keys, id_col, order, keep=None):
    """Overlapping re-reads: the last row of each id wins; ``keep`` leaves the newest ids only, as a live view does."""
    rest = [c for c in df.columns if c not in (*keys, id_col)]
    latest = (
        df.groupBy(*keys, id_col)
        .agg(F.max_by(F.struct(*rest), order).alias("_last"))
        .select(*keys, id_col, "_last.*")
    )
    return latest if keep is None else top_n(latest, list(keys), [F.desc(id_col)], keep, [id_col])
