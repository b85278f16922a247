"""A tiny Spark application that writes an event log: ``app_with_log.py FOLDER``."""

import sys

from pyspark.sql import SparkSession, functions as F

folder = sys.argv[1]
spark = (
    SparkSession.builder.master("local[2]").appName("probe")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{folder}/events")
    .config("spark.eventLog.logBlockUpdates.enabled", "true").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
spark.sparkContext.setJobDescription("count by key")
spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().collect()
spark.sparkContext.setJobDescription(None)
try:
    spark.range(10).select(F.when(F.col("id") == 5, F.raise_error(F.lit("planned failure"))).otherwise(F.col("id"))).collect()
except Exception:
    pass
kept = spark.sparkContext.parallelize(range(4000), 3).setName("kept numbers").persist()
kept.count()
freed = spark.sparkContext.parallelize(range(50), 2).persist()
freed.count()
freed.unpersist(blocking=True)
spark.range(100).write.parquet(f"{folder}/in")
query = (
    spark.readStream.schema("id bigint").parquet(f"{folder}/in").groupBy((F.col("id") % 3).alias("k")).count()
    .writeStream.queryName("agg").outputMode("complete").format("memory").trigger(availableNow=True)
    .option("checkpointLocation", f"{folder}/checkpoint").start()
)
query.awaitTermination()
spark.stop()
