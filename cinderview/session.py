"""Session settings the operators rely on, and the shared working folder."""

import os
import uuid

from pyspark.sql import SparkSession

# Settings every session of this package uses.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# What every query sets on the session it is given. Skewed joins
# are split even where that costs a shuffle.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cores="*", app="cinderview", partitions=8, extra=None):
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = dict(SETTINGS)
    settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings["spark.ui.enabled"] = "false"
    settings["spark.ui.showConsoleProgress"] = "false"
    settings["spark.driver.memory"] = os.environ.get("CINDERVIEW_DRIVER_MEMORY", "12g")
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark):
    """Set the time zone results depend on and skew handling; leave sizing to the cluster."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    # Python workers on this machine find the package wherever the driver was started from.
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark


def shared_folder(spark):
    """Folder every executor can reach: the cluster's checkpoint folder.

    A local session that names none, as in tests, is given one of its own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark._jvm.java.lang.System.getProperty('java.io.tmpdir')}/cinderview-checkpoints"


# Scratch folder of each application, deleted when its driver ends.
_scratch = {}


def scratch_path(spark, name):
    """A fresh path below the shared folder, deleted with all others of this application when it ends."""
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        folder = f"{shared_folder(spark)}/cinderview/{application}-{uuid.uuid4().hex}"
        path, files = file_system(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch[application] = folder
    return f"{_scratch[application]}/{name}-{uuid.uuid4().hex}"


def file_system(spark, folder):
    """A folder as Hadoop's path, and the file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, folder):
    path, files = file_system(spark, folder)
    return files.exists(path)


def delete(spark, folder):
    path, files = file_system(spark, folder)
    files.delete(path, True)


def rename(spark, folder, new):
    """Give a folder a new name, if it is there."""
    path, files = file_system(spark, folder)
    if files.exists(path):
        files.rename(path, file_system(spark, new)[0])


def written(spark, df, name):
    """``df`` as a Parquet table in the shared folder.

    For results that several branches of a report read: they are computed once
    and survive the loss of executors.
    """
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
