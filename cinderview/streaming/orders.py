"""The demo workload: raw orders and revenue per customer and minute."""

from pyspark.sql import functions as F

# Regions an order id maps to.
REGIONS = ["eu", "us", "apac"]
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
RAW_TRIGGER, AGG_TRIGGER = "5 seconds", "10 seconds"
WATERMARK, WINDOW = "30 seconds", "1 minute"


def orders(events):
    """Order columns from an event stream or table."""
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("event_id") % 3 + 1).cast("int"))
    return events.select(
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_id").alias("order_id"),
        F.col("user_id").alias("customer_id"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        region.alias("region"),
    )


def orders_stream(spark, path, glob="*.parquet", files_per_trigger=None):
    """Orders as a stream over the event files that match ``glob`` below ``path``."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return orders(reader.parquet(path))


def _triggered(writer, trigger):
    return writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)


def start_raw(df, out, checkpoint, trigger=RAW_TRIGGER, partition="region"):
    """Append every row to Parquet, one folder per ``partition`` value."""
    writer = (
        df.writeStream.queryName("orders-raw").format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    if partition:
        writer = writer.partitionBy(partition)
    return _triggered(writer, trigger).start()


def windowed_revenue(df, watermark=WATERMARK, window=WINDOW):
    """Revenue and orders per customer and tumbling window; late rows are dropped."""
    return (
        df.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window).alias("window"), "customer_id")
        .agg(F.sum("amount").alias("revenue"), F.count("order_id").alias("orders"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "customer_id", "revenue", "orders",
        )
    )


def start_revenue(df, out, checkpoint, trigger=AGG_TRIGGER):
    writer = (
        df.writeStream.queryName("orders-agg").format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, trigger).start()


def poison_guard(df, every, id_col="order_id"):
    """Fail on every ``every``-th id above 0; all other rows pass."""
    bad = (F.col(id_col) > 0) & (F.col(id_col) % every == 0)
    message = F.concat(F.lit("poison order "), F.col(id_col).cast("string"))
    return df.withColumn(id_col, F.when(bad, F.raise_error(message).cast("long")).otherwise(F.col(id_col)))
