"""Fixed, tolerant schemas: every field may be missing, unknown fields are ignored."""


def as_type(ddl):
    """A column list (``name TYPE, ...``) as one struct type text."""
    out, depth = [], 0
    for part in ddl.replace("\n", " ").split(","):
        item = part.strip()
        if depth == 0:
            name, kind = item.split(" ", 1)
            item = f"{name}: {kind.strip()}"
        depth += part.count("<") - part.count(">")
        out.append(item)
    return f"STRUCT<{', '.join(out)}>"


# Task metrics inside REST task rows.
_TASK_METRICS = """
executorRunTime BIGINT, jvmGcTime BIGINT, resultSize BIGINT, memoryBytesSpilled BIGINT, diskBytesSpilled BIGINT,
peakExecutionMemory BIGINT, inputMetrics STRUCT<bytesRead: BIGINT, recordsRead: BIGINT>,
outputMetrics STRUCT<bytesWritten: BIGINT, recordsWritten: BIGINT>,
shuffleReadMetrics STRUCT<remoteBytesRead: BIGINT, localBytesRead: BIGINT, fetchWaitTime: BIGINT>,
shuffleWriteMetrics STRUCT<bytesWritten: BIGINT, writeTime: BIGINT>"""

_STAGE_EXECUTOR = (
    "STRUCT<taskTime: BIGINT, failedTasks: BIGINT, succeededTasks: BIGINT, killedTasks: BIGINT, inputBytes: BIGINT, "
    "outputBytes: BIGINT, shuffleRead: BIGINT, shuffleWrite: BIGINT, memoryBytesSpilled: BIGINT, diskBytesSpilled: BIGINT, "
    "isBlacklistedForStage: BOOLEAN, isExcludedForStage: BOOLEAN>"
)

# REST entities by table.
REST = {
    "applications": """id STRING, name STRING, attempts ARRAY<STRUCT<attemptId: STRING, startTime: STRING, endTime: STRING,
        lastUpdated: STRING, duration: BIGINT, sparkUser: STRING, completed: BOOLEAN, appSparkVersion: STRING>>""",
    "jobs": """jobId BIGINT, name STRING, description STRING, status STRING, submissionTime STRING, completionTime STRING,
        numTasks BIGINT, numActiveTasks BIGINT, numCompletedTasks BIGINT, numSkippedTasks BIGINT, numFailedTasks BIGINT,
        numKilledTasks BIGINT, numCompletedStages BIGINT, numFailedStages BIGINT, stageIds ARRAY<BIGINT>""",
    "stages": f"""stageId BIGINT, attemptId BIGINT, name STRING, description STRING, status STRING, schedulingPool STRING,
        submissionTime STRING, completionTime STRING, failureReason STRING, numTasks BIGINT, numActiveTasks BIGINT,
        numCompleteTasks BIGINT, numFailedTasks BIGINT, numKilledTasks BIGINT, executorRunTime BIGINT, jvmGcTime BIGINT,
        inputBytes BIGINT, outputBytes BIGINT, shuffleReadBytes BIGINT, shuffleWriteBytes BIGINT,
        memoryBytesSpilled BIGINT, diskBytesSpilled BIGINT, executorSummary MAP<STRING, {_STAGE_EXECUTOR}>""",
    "executors": """id STRING, hostPort STRING, isActive BOOLEAN, addTime STRING, removeTime STRING, removeReason STRING,
        totalCores BIGINT, activeTasks BIGINT, failedTasks BIGINT, completedTasks BIGINT, totalDuration BIGINT, totalGCTime BIGINT,
        totalShuffleRead BIGINT, totalShuffleWrite BIGINT, memoryUsed BIGINT, maxMemory BIGINT, diskUsed BIGINT,
        isExcluded BOOLEAN, isBlacklisted BOOLEAN, executorLogs MAP<STRING, STRING>, peakMemoryMetrics MAP<STRING, BIGINT>,
        memoryMetrics STRUCT<usedOnHeapStorageMemory: BIGINT, usedOffHeapStorageMemory: BIGINT, totalOnHeapStorageMemory: BIGINT,
        totalOffHeapStorageMemory: BIGINT>, resourceProfileId BIGINT""",
    "sql": """id BIGINT, status STRING, description STRING, planDescription STRING, submissionTime STRING, duration BIGINT,
        runningJobIds ARRAY<BIGINT>, successJobIds ARRAY<BIGINT>, failedJobIds ARRAY<BIGINT>, errorMessage STRING,
        nodes ARRAY<STRUCT<nodeId: BIGINT, nodeName: STRING, wholeStageCodegenId: BIGINT,
        metrics: ARRAY<STRUCT<name: STRING, value: STRING>>>>""",
    "rdds": """id BIGINT, name STRING, numPartitions BIGINT, numCachedPartitions BIGINT, storageLevel STRING, memoryUsed BIGINT,
        diskUsed BIGINT, dataDistribution ARRAY<STRUCT<address: STRING, memoryUsed: BIGINT, memoryRemaining: BIGINT, diskUsed: BIGINT>>,
        partitions ARRAY<STRUCT<blockName: STRING, storageLevel: STRING, memoryUsed: BIGINT, diskUsed: BIGINT, executors: ARRAY<STRING>>>""",
    "threads": """threadId BIGINT, threadName STRING, threadState STRING, stackTrace STRING, blockedByThreadId BIGINT,
        blockedByLock STRING, holdingLocks ARRAY<STRING>, lockName STRING, lockOwnerName STRING, isDaemon BOOLEAN""",
    "environment": """runtime STRUCT<javaVersion: STRING, javaHome: STRING, scalaVersion: STRING>,
        sparkProperties ARRAY<ARRAY<STRING>>, hadoopProperties ARRAY<ARRAY<STRING>>, systemProperties ARRAY<ARRAY<STRING>>,
        metricsProperties ARRAY<ARRAY<STRING>>, classpathEntries ARRAY<ARRAY<STRING>>,
        resourceProfiles ARRAY<STRUCT<id: BIGINT, executorResources: MAP<STRING, STRUCT<resourceName: STRING, amount: BIGINT>>,
        taskResources: MAP<STRING, STRUCT<resourceName: STRING, amount: DOUBLE>>>>""",
}


REST["tasks"] = f"""taskId BIGINT, index BIGINT, attempt BIGINT, launchTime STRING, duration BIGINT, executorId STRING, host STRING,
    status STRING, taskLocality STRING, speculative BOOLEAN, errorMessage STRING, schedulerDelay BIGINT,
    taskMetrics {as_type(_TASK_METRICS.strip())}"""

# One streaming progress object; the last field catches text that is no JSON.
PROGRESS = """id STRING, runId STRING, name STRING, timestamp STRING, batchId BIGINT, batchDuration BIGINT, numInputRows BIGINT,
    inputRowsPerSecond DOUBLE, processedRowsPerSecond DOUBLE, durationMs MAP<STRING, BIGINT>, eventTime MAP<STRING, STRING>,
    stateOperators ARRAY<STRUCT<operatorName: STRING, numRowsTotal: BIGINT, numRowsUpdated: BIGINT, memoryUsedBytes: BIGINT,
    numRowsDroppedByWatermark: BIGINT>>, sources ARRAY<STRUCT<description: STRING, numInputRows: BIGINT,
    inputRowsPerSecond: DOUBLE, processedRowsPerSecond: DOUBLE>>, sink STRUCT<description: STRING, numOutputRows: BIGINT>,
    _corrupt_record STRING"""
