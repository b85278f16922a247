"""The bundle: everything known about each application, written per app."""

from pyspark.sql import functions as F

from ..functions.ordered import union_all
from ..operators.logs import log_tail


def write_bundle(tables, path, lines=None, tail=None, fmt="json", mode="errorifexists"):
    """Write each table below ``path`` split by ``app_id``, plus the logs.

    ``tail`` keeps the last so many lines of every log; by default all are written.

    ``tables`` maps names (``summary``, ``snapshot``, ``failures``,
    ``streaming``, ``environment``, ``metrics``) to DataFrames with ``app_id``.
    """
    for name, df in tables.items():
        df.write.mode(mode).partitionBy("app_id").format(fmt).save(f"{path}/{name}")
    if lines is not None:
        (lines if tail is None else log_tail(lines, tail)).write.mode(mode).partitionBy("app_id").format(fmt).save(f"{path}/logs")
    return path


def bundle_contents(spark, path, text_of, fmt="json"):
    """Rows per part of a bundle and app, and the total length of one text column; ``text_of`` maps parts to it."""
    counts = [
        spark.read.format(fmt).load(f"{path}/{part}").groupBy("app_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(text).cast("long")).alias("chars"))
        .withColumn("part", F.lit(part))
        for part, text in text_of.items()
    ]
    return union_all(counts)


def write_markdown(markdown, path, mode="errorifexists"):
    """The Markdown lines of each app as text in its folder, in order; a long summary is several files."""
    place = ["app_id", "section_no", "part", "ord", "sub"]
    sorted_lines = markdown.repartitionByRange(*place).sortWithinPartitions(*place)
    sorted_lines.select("app_id", F.col("text").alias("value")).write.mode(mode).partitionBy("app_id").text(path)
    return path
