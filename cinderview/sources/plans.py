"""Nodes of SQL plans and their metrics from event logs.

The plan of an execution is the last one told: that of its start, or of the last
adaptive update in the order of the log. It is unfolded level by level, whatever its
depth; the place of a node is the list of child numbers that leads to it, so the order
of places is the order in which plans are numbered.
"""

from pyspark.sql import Window, functions as F

from ..functions.ordered import union_all
from ..session import written
from .events import SQL_UI, of_kind

# Nodes that plan graphs leave out, the last with all below it (shown where it is first made).
WRAPPERS = ["InputAdapter", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"]
REUSED = "ReusedExchange"

_NODE = "nodeName STRING, simpleString STRING, metrics ARRAY<STRUCT<name: STRING, accumulatorId: BIGINT, metricType: STRING>>, children ARRAY<STRING>"
_PLAN = ["app_id", "execution_id"]


def last_plans(events):
    """``app_id, execution_id, plan``: JSON of the plan an execution ran in the end."""
    start = events.where(F.col("event") == SQL_UI + "SparkListenerSQLExecutionStart").select(
        "app_id", "pos", F.from_json("value", "executionId BIGINT, sparkPlanInfo STRING").alias("e"), F.lit(0).alias("turn")
    )
    update = of_kind(events, SQL_UI + "SparkListenerSQLAdaptiveExecutionUpdate").withColumn("turn", F.lit(1))
    told = start.unionByName(update).where(F.col("e.sparkPlanInfo").isNotNull())
    return told.groupBy("app_id", F.col("e.executionId").alias("execution_id")).agg(F.max_by("e.sparkPlanInfo", F.struct("turn", "pos")).alias("plan"))


def plan_nodes(events):
    """``app_id, execution_id, node_id, node_name, description, codegen_id, metrics`` of every node shown."""
    spark = events.sparkSession
    place, none = F.array().cast("array<int>").alias("place"), F.lit(None).cast("long").alias("codegen_id")
    level, found = last_plans(events).select(*_PLAN, place, none, F.from_json("plan", _NODE).alias("n")), []
    while True:
        level = written(spark, level.select(*_PLAN, "place", "codegen_id", "n.*"), "plan-level")
        if level.isEmpty():
            break
        found.append(level.drop("children"))
        # Nodes below a generated stage belong to it, up to the next input.
        stage = F.regexp_extract("nodeName", r"^WholeStageCodegen \((\d+)\)", 1).try_cast("long")
        inside = F.when(stage.isNotNull(), stage).when(~F.col("nodeName").isin(WRAPPERS), F.col("codegen_id"))
        below = level.where(F.col("nodeName") != REUSED).select(*_PLAN, "place", inside.alias("codegen_id"), F.posexplode("children").alias("child", "json"))
        level = below.select(*_PLAN, F.concat("place", F.array("child")).alias("place"), "codegen_id", F.from_json("json", _NODE).alias("n"))
    if not found:
        found = [level.drop("children")]
    shown = union_all(found).where(~F.col("nodeName").isin([*WRAPPERS, REUSED]))
    number = F.row_number().over(Window.partitionBy(*_PLAN).orderBy("place")).cast("long") - 1
    return shown.select(
        *_PLAN, number.alias("node_id"), F.col("nodeName").alias("node_name"), F.col("simpleString").alias("description"), "codegen_id", "metrics"
    )


def metric_updates(events):
    """``app_id, accumulator, total, least, most, updates``: what tasks that succeeded and the driver reported of every metric."""
    ended = F.from_json("value", """`Task End Reason` STRUCT<`Reason`: STRING>,
        `Task Info` STRUCT<`Accumulables`: ARRAY<STRUCT<`ID`: BIGINT, `Update`: STRING, `Metadata`: STRING>>>""")
    tasks = events.where(F.col("event") == "SparkListenerTaskEnd").select("app_id", ended.alias("e")).where("e.`Task End Reason`.Reason = 'Success'")
    of_tasks = (
        tasks.select("app_id", F.explode("e.`Task Info`.Accumulables").alias("a"))
        .where("a.Metadata = 'sql'")
        .select("app_id", F.col("a.ID").alias("accumulator"), F.col("a.Update").try_cast("long").alias("value"))
    )
    of_driver = of_kind(events, SQL_UI + "SparkListenerDriverAccumUpdates").select("app_id", F.explode("e.accumUpdates").alias("u"))
    of_driver = of_driver.select("app_id", F.get("u", F.lit(0)).alias("accumulator"), F.get("u", F.lit(1)).alias("value"))
    # A metric that never started reports a negative number.
    return of_tasks.unionByName(of_driver).where("value >= 0").groupBy("app_id", "accumulator").agg(
        F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("updates")
    )


def metric_text(kind, total, updates):
    """A metric's total as plan pages show it, by its type."""
    size = F.when(total >= 0, F.concat(F.format_string("%.1f", total.cast("double")), F.lit(" B")))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        size = F.when(total >= 2 * 1024**power, F.concat(F.format_string("%.1f", total / float(1024**power)), F.lit(" " + unit))).otherwise(size)
    ms = F.when(kind == "nsTiming", F.floor(total / 1000000)).otherwise(total)
    time = (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 60000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit(" s")))
        .when(ms < 3600000, F.concat(F.format_string("%.1f", ms / 60000.0), F.lit(" m")))
        .otherwise(F.concat(F.format_string("%.2f", ms / 3600000.0), F.lit(" h")))
    )
    # Averages are reported ten-fold.
    average = F.format_number(total / updates / 10.0, 1)
    return F.when(kind == "size", size).when(kind.isin("timing", "nsTiming"), time).when(kind == "average", average).otherwise(F.format_number(total, 0))


def node_metrics(events):
    """One row per metric of a node that was reported: what ``settings.node_top_metrics`` reads.

    ``app_id, execution_id, node_id, node_name, codegen_id, pos, metric, kind, value, total, least, most, updates``.
    """
    listed = plan_nodes(events).select(*_PLAN, "node_id", "node_name", "codegen_id", F.posexplode("metrics").alias("pos", "m"))
    listed = listed.select(
        *_PLAN, "node_id", "node_name", "codegen_id", F.col("pos").cast("long").alias("pos"), F.col("m.name").alias("metric"),
        F.col("m.metricType").alias("kind"), F.col("m.accumulatorId").alias("accumulator"),
    )
    value = metric_text(F.col("kind"), F.col("total"), F.col("updates"))
    return listed.join(metric_updates(events), ["app_id", "accumulator"]).withColumn("value", value).drop("accumulator")
