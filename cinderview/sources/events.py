"""Event logs as a table ``app_id, event, value, pos`` with one JSON event per row.

Each table parses only the events it needs with a fixed schema, after a plain text
test on the event name. ``pos`` orders the events of one application: the number of a
rolling log's file, the place of the split in it, and the row in the split.
"""

import contextlib

from pyspark.sql import functions as F

from ..schemas import PROGRESS, as_type

SQL_UI = "org.apache.spark.sql.execution.ui."
SCHEDULER = "org.apache.spark.scheduler.SparkListener"
PROGRESS_EVENT = "org.apache.spark.sql.streaming.StreamingQueryListener$QueryProgressEvent"

# Files a task keeps open for kinds that no table reads; with more kinds the rest is sorted.
OTHER_KINDS = 32

_STAGE_INFO = (
    "STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT, `Stage Name`: STRING, `Number of Tasks`: BIGINT, "
    "`Submission Time`: BIGINT, `Completion Time`: BIGINT, `Failure Reason`: STRING, `Resource Profile Id`: BIGINT>"
)
# Fields read of each event.
EVENT_FIELDS = {
    "SparkListenerLogStart": "`Spark Version` STRING",
    "SparkListenerApplicationStart": "`App Name` STRING, `App ID` STRING, `Timestamp` BIGINT, `User` STRING, `App Attempt ID` STRING",
    "SparkListenerApplicationEnd": "`Timestamp` BIGINT",
    "SparkListenerJobStart": f"`Job ID` BIGINT, `Submission Time` BIGINT, `Stage Infos` ARRAY<{_STAGE_INFO}>, `Stage IDs` ARRAY<BIGINT>, `Properties` MAP<STRING, STRING>",
    "SparkListenerJobEnd": "`Job ID` BIGINT, `Completion Time` BIGINT, `Job Result` STRUCT<`Result`: STRING>",
    "SparkListenerStageSubmitted": f"`Stage Info` {_STAGE_INFO}, `Properties` MAP<STRING, STRING>",
    "SparkListenerStageCompleted": f"`Stage Info` {_STAGE_INFO}",
    "SparkListenerTaskStart": "`Stage ID` BIGINT, `Task Info` STRUCT<`Task ID`: BIGINT, `Executor ID`: STRING>",
    "SparkListenerTaskEnd": """`Stage ID` BIGINT, `Stage Attempt ID` BIGINT,
        `Task End Reason` STRUCT<`Reason`: STRING, `Class Name`: STRING, `Description`: STRING, `Full Stack Trace`: STRING,
            `Message`: STRING, `Kill Reason`: STRING, `Executor ID`: STRING, `Exit Caused By App`: BOOLEAN, `Loss Reason`: STRING>,
        `Task Info` STRUCT<`Task ID`: BIGINT, `Index`: BIGINT, `Attempt`: BIGINT, `Launch Time`: BIGINT, `Executor ID`: STRING,
            `Host`: STRING, `Locality`: STRING, `Speculative`: BOOLEAN, `Getting Result Time`: BIGINT, `Finish Time`: BIGINT,
            `Failed`: BOOLEAN, `Killed`: BOOLEAN>,
        `Task Executor Metrics` MAP<STRING, BIGINT>,
        `Task Metrics` STRUCT<`Executor Deserialize Time`: BIGINT, `Executor Run Time`: BIGINT, `Peak Execution Memory`: BIGINT,
            `Result Serialization Time`: BIGINT, `JVM GC Time`: BIGINT, `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT,
            `Shuffle Read Metrics`: STRUCT<`Fetch Wait Time`: BIGINT, `Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>,
            `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>,
            `Input Metrics`: STRUCT<`Bytes Read`: BIGINT>>""",
    "SparkListenerExecutorAdded": "`Timestamp` BIGINT, `Executor ID` STRING, `Executor Info` STRUCT<`Host`: STRING, `Total Cores`: BIGINT, `Resource Profile Id`: BIGINT>",
    "SparkListenerExecutorRemoved": "`Timestamp` BIGINT, `Executor ID` STRING, `Removed Reason` STRING",
    "SparkListenerBlockManagerAdded": "`Block Manager ID` STRUCT<`Executor ID`: STRING, `Host`: STRING, `Port`: BIGINT>, `Maximum Memory` BIGINT",
    SCHEDULER + "ExecutorExcluded": "time BIGINT, executorId STRING, taskFailures BIGINT",
    SCHEDULER + "ExecutorUnexcluded": "time BIGINT, executorId STRING",
    SCHEDULER + "ExecutorExcludedForStage": "time BIGINT, executorId STRING, taskFailures BIGINT, stageId BIGINT, stageAttemptId BIGINT",
    SCHEDULER + "NodeExcluded": "time BIGINT, hostId STRING, executorFailures BIGINT",
    SCHEDULER + "NodeUnexcluded": "time BIGINT, hostId STRING",
    SCHEDULER + "NodeExcludedForStage": "time BIGINT, hostId STRING, executorFailures BIGINT, stageId BIGINT, stageAttemptId BIGINT",
    "SparkListenerBlockManagerRemoved": "`Block Manager ID` STRUCT<`Executor ID`: STRING>, `Timestamp` BIGINT",
    "SparkListenerBlockUpdated": """`Block Updated Info` STRUCT<`Block Manager ID`: STRUCT<`Executor ID`: STRING, `Host`: STRING, `Port`: BIGINT>,
        `Block ID`: STRING, `Storage Level`: STRUCT<`Use Disk`: BOOLEAN, `Use Memory`: BOOLEAN>, `Memory Size`: BIGINT, `Disk Size`: BIGINT>""",
    "SparkListenerUnpersistRDD": "`RDD ID` BIGINT",
    SQL_UI + "SparkListenerSQLAdaptiveExecutionUpdate": "executionId BIGINT, sparkPlanInfo STRING",
    SQL_UI + "SparkListenerDriverAccumUpdates": "executionId BIGINT, accumUpdates ARRAY<ARRAY<BIGINT>>",
    SQL_UI + "SparkListenerSQLExecutionStart": "executionId BIGINT, description STRING, physicalPlanDescription STRING, time BIGINT",
    SQL_UI + "SparkListenerSQLExecutionEnd": "executionId BIGINT, time BIGINT, errorMessage STRING",
    "SparkListenerEnvironmentUpdate": """`Spark Properties` MAP<STRING, STRING>, `Hadoop Properties` MAP<STRING, STRING>,
        `System Properties` MAP<STRING, STRING>, `Metrics Properties` MAP<STRING, STRING>, `Classpath Entries` MAP<STRING, STRING>""",
    "SparkListenerResourceProfileAdded": "`Resource Profile Id` BIGINT, `Executor Resource Requests` MAP<STRING, STRUCT<`Resource Name`: STRING, `Amount`: BIGINT>>",
    PROGRESS_EVENT: f"progress {as_type(PROGRESS)}",
}


def app_of(path):
    """App id from an event log's path: its rolling folder, else its file name."""
    folder = F.regexp_extract(path, r"/eventlog_v2_([^/]+)/[^/]+$", 1)
    file = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(\.inprogress|\.zstd|\.lz4|\.snappy|\.lzf|\.zst|\.compact)+$", "")
    return F.when(folder != "", folder).otherwise(file)


def file_number(path):
    """Number of a rolling log's file; 0 for logs of one file."""
    # Null where there is none: a cast of an empty text fails inside, for every line of the log.
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/events_(\d+)_[^/]*$", 1), F.lit("")).try_cast("long"), F.lit(0))


def events_of(lines):
    """``app_id, event, value, pos`` from ``app_id, value`` rows; the event name leads each line. ``pos`` may be missing."""
    name = F.regexp_extract("value", r'^\s*\{\s*"Event"\s*:\s*"([^"]+)"', 1)
    if "pos" not in lines.columns:
        lines = lines.withColumn("pos", F.lit(None).cast("struct<file:bigint,block:bigint,row:bigint>"))
    # A row for each name found (one or none): a plain filter on the name would be evaluated below, together with all that makes ``value``.
    found = F.filter(F.array(name), lambda x: x != "")
    return lines.select("*", F.explode(found).alias("event"))


def read_events(spark, path):
    """All event lines below a folder (plain, compressed, rolling)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    place = F.col("_metadata.file_block_start")
    pos = F.struct(file_number(file).alias("file"), place.alias("block"), F.monotonically_increasing_id().alias("row"))
    return events_of(lines.select(app_of(file).alias("app_id"), "value", pos.alias("pos")))


def land_events(events, path):
    """Write events once, split by kind, so that every table reads only its own."""
    write_by_kind(events, path, "errorifexists")
    return events.sparkSession.read.parquet(path)


def write_by_kind(events, path, mode):
    """Write events to one folder a kind, without a sort of the lines: a task keeps a file open for each of the few kinds."""
    with open_files(events.sparkSession, len(EVENT_FIELDS) + OTHER_KINDS):
        events.write.partitionBy("event").option("compression", "zstd").mode(mode).parquet(path)


@contextlib.contextmanager
def open_files(spark, number):
    """While it lasts, tasks that write by a column keep so many files open instead of sorting their rows."""
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(number))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", before)


def of_kind(events, kind, fields=None):
    """Events of one kind, parsed as ``e``: with all fields that are read of it, or only ``fields`` of them."""
    e = F.from_json("value", fields or EVENT_FIELDS[kind])
    return events.where(F.col("event") == kind).select("app_id", "pos", e.alias("e"))


def long(col):
    return F.coalesce(col, F.lit(0))
