"""The driver's metrics registry: sources, order, health."""

from pyspark.sql import functions as F

from ..functions.ordered import all_of
from ..functions.text import fixed, number_text
from .rates import CHUNK_SPAN, counter_rate

# Spark's own metric sources in reading order.
BUILTIN_SOURCES = [
    "LiveListenerBus",
    "DAGScheduler",
    "BlockManager",
    "CodeGenerator",
    "JVMCPUTime",
    "ExecutorMetrics",
    "ExecutorAllocationManager",
    "HiveExternalCatalog",
    "appStatus",
    "jvm",
    "spark.streaming",
    "AccumulatorSource",
]
# Short forms of a timer's units.
UNIT_SUFFIX = {"milliseconds": "ms", "microseconds": "µs", "nanoseconds": "ns", "seconds": "s"}


def source_rank(source="source"):
    """Place of a built-in source counted from 1; 0 for the application's own."""
    return F.array_position(F.array(*[F.lit(s) for s in BUILTIN_SOURCES]), F.col(source))


def metric_sources(metrics, keys=("app_id",)):
    return metrics.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("metrics"))


def metric_order(metrics):
    """Application sources first, then the built-ins in their order, then by name."""
    return metrics.withColumn("source_rank", source_rank()).orderBy("app_id", "source_rank", "source", "name")


def metric_text(rate=None):
    """Headline value and detail text of a metric row; ``rate`` is a column name or SQL text."""
    kind, value = F.col("kind"), number_text("value")
    num = lambda name: number_text(f"coalesce({name}, 0D)")
    per_s = lambda name, label: F.concat(num(name), F.lit(label))
    unit = F.coalesce(*[F.when(F.col("units") == u, F.lit(s)) for u, s in UNIT_SUFFIX.items()], F.lit(""))
    head = F.when((kind == "gauge") & F.col("text").isNotNull(), F.col("text")).otherwise(value)
    meter = F.concat(
        per_s("m1_rate", "/s (1m) · "), per_s("m5_rate", "/s (5m) · "), per_s("mean_rate", "/s mean")
    )
    rest = F.coalesce(F.concat(F.lit(" · "), number_text("m1_rate"), F.lit("/s")), F.lit(""))
    rest = F.when(F.col("m1_rate").isNotNull(), rest).otherwise(F.lit(""))
    spread = F.concat(
        F.lit("mean "), num("mean"), unit, F.lit(" · p50 "), num("p50"), unit, F.lit(" · p95 "), num("p95"), unit,
        F.lit(" · max "), num("max"), unit, rest,
    )
    counter = F.lit("") if rate is None else F.coalesce(
        F.when(F.expr(rate).isNotNull(), F.concat(number_text(rate), F.lit("/s since last poll"))), F.lit("")
    )
    detail = (
        F.when(kind == "gauge", F.lit(""))
        .when(kind == "counter", counter)
        .when(kind == "meter", meter)
        .otherwise(spread)
    )
    return head.alias("headline"), detail.alias("detail")


def driver_health(metrics, ts="poll_s", span=CHUNK_SPAN, with_cpu=True):
    """Health rows ``(label, value, warn)`` per app and poll; a row needs its metric.

    Expects ``key, source, name, value, p95, mean, max``. All built-in numbers
    are gathered in one aggregate per poll; the CPU rate needs the poll before
    (``with_cpu=False`` for a single poll).
    """
    keys = ["app_id", ts]
    rated = metrics.withColumn("cpu_rate", F.lit(None).cast("double"))
    if with_cpu:
        cpu = counter_rate(
            metrics.where(F.col("key") == "JVMCPUTime.jvmCpuTime"), ["app_id", "key"], ts, "value", span
        ).select(*keys, F.col("rate").alias("cpu_rate"))
        rated = metrics.join(cpu, keys, "left")

    def of(key, col="value"):
        return F.max(F.when(F.col("key") == key, F.col(col)))

    def seen(key):
        return F.max(F.col("key") == key)

    stage = lambda n: F.coalesce(of(f"DAGScheduler.stage.{n}"), F.lit(0.0)).alias(f"_{n}")
    bus = F.col("source") == "LiveListenerBus"
    facts = rated.groupBy(*keys).agg(
        F.max(bus).alias("_bus"),
        F.coalesce(
            F.sum(F.when(bus & F.col("name").endswith("numDroppedEvents"), F.col("value"))), F.lit(0.0)
        ).alias("_dropped"),
        seen("DAGScheduler.messageProcessingTime").alias("_has_message"),
        F.coalesce(of("DAGScheduler.messageProcessingTime", "p95"), F.lit(0.0)).alias("_message"),
        seen("DAGScheduler.stage.runningStages").alias("_has_stages"),
        stage("runningStages"), stage("waitingStages"), stage("failedStages"),
        of("BlockManager.memory.memUsed_MB").alias("_used"),
        of("BlockManager.memory.remainingMem_MB").alias("_left"),
        seen("CodeGenerator.compilationTime").alias("_has_codegen"),
        F.coalesce(of("CodeGenerator.compilationTime"), F.lit(0.0)).alias("_compiled"),
        F.coalesce(of("CodeGenerator.compilationTime", "mean"), F.lit(0.0)).alias("_compile_mean"),
        F.coalesce(of("CodeGenerator.compilationTime", "max"), F.lit(0.0)).alias("_compile_max"),
        F.max("cpu_rate").alias("_cpu"),
    )
    total = F.col("_used") + F.col("_left")
    pct = F.when(total > 0, F.lit(100.0) * F.col("_used") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))

    def row(present, ord_, label, value, warn):
        return F.when(
            present,
            F.struct(F.lit(ord_).alias("ord"), F.lit(label).alias("label"), value.alias("value"), warn.alias("warn")),
        )

    n = number_text
    rows = F.array(
        row(
            F.col("_bus"), 1, "listener events dropped",
            F.when(
                F.col("_dropped") > 0,
                F.concat(
                    n("_dropped"),
                    F.lit(" — the UI/REST API has missed events; raise spark.scheduler.listenerbus.eventqueue.capacity"),
                ),
            ).otherwise(F.lit("0")),
            F.col("_dropped") > 0,
        ),
        row(F.col("_has_message"), 2, "scheduler message time p95", F.concat(n("_message"), F.lit("ms")), F.col("_message") > 1000),
        row(
            F.col("_has_stages"), 3, "stages running / waiting / failed",
            F.concat_ws(" / ", n("_runningStages"), n("_waitingStages"), n("_failedStages")),
            F.col("_failedStages") > 0,
        ),
        row(
            all_of([F.col("_used").isNotNull(), F.col("_left").isNotNull()]), 4, "block manager memory",
            F.concat(n("_used"), F.lit(" of "), n("_used + _left"), F.lit(" MiB ("), fixed(pct, 0), F.lit("%)")),
            pct >= 90,
        ),
        row(
            F.col("_has_codegen"), 5, "codegen compile",
            F.concat(
                n("_compiled"), F.lit(" compilations · mean "), n("_compile_mean"), F.lit("ms · max "),
                n("_compile_max"), F.lit("ms"),
            ),
            F.lit(False),
        ),
        row(F.col("_cpu").isNotNull(), 6, "driver CPU", F.concat(fixed(F.col("_cpu") / 1e9, 2), F.lit(" cores")), F.lit(False)),
    )
    return facts.select(*keys, F.inline(F.array_compact(rows)))
