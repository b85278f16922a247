"""Log files as line tables."""

from pyspark.sql import Window, functions as F

from ..session import written


def raw_lines(reader, path):
    """Lines with the file and file split they are from."""
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"),
    )


def numbered(spark, raw):
    """``raw_lines`` with ``line_no``, counted from 0 in each file, split over tasks.

    A line's number is its place within its file split plus the lines of the
    splits before it, so no task has to read a whole file. Lines are written
    once with an id that counts on within a split; numbers and line counts both
    come from that table.
    """
    lines = written(spark, raw.withColumn("_id", F.monotonically_increasing_id()), "log-lines")
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    joined = lines.join(splits, ["file", "_block"])
    return joined.withColumn("line_no", F.col("_id") - F.col("_first") + F.col("_offset")).drop("_id", "_first", "_offset", "_block")


def app_of_file(app_id=None):
    """The app a log belongs to: the folder it is in, unless one is given."""
    return F.regexp_extract("file", r"([^/]+)/[^/]*$", 1) if app_id is None else F.lit(app_id)


def read_logs(spark, path, app_id=None):
    """``app_id, file, line_no, line`` of text log files."""
    return numbered(spark, raw_lines(spark.read, path)).select(app_of_file(app_id).alias("app_id"), "file", "line_no", "line")
