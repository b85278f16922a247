"""Driver metrics registry JSON as metric rows."""

from pyspark.sql import functions as F

from ..functions.ordered import union_all

# Registry sections and the kind of their metrics.
SECTIONS = [("gauges", "gauge"), ("counters", "counter"), ("meters", "meter"), ("histograms", "histogram"), ("timers", "timer")]
DRIVER = ".driver."
STREAMING = "spark.streaming."


def parse_metrics(df, col="json"):
    """Rows ``key, source, name, kind, value, text, fields, units`` per registry.

    Values are read as variants: a number, a flag and a text that looks like a
    number stay apart.
    """
    keep = [c for c in df.columns if c != col]
    parts = []
    for section, kind in SECTIONS:
        metrics = F.from_json(F.get_json_object(F.col(col), f"$.{section}"), "MAP<STRING, MAP<STRING, VARIANT>>")
        parts.append(df.select(*keep, F.lit(kind).alias("kind"), F.explode(metrics).alias("full", "m")))
    rows = union_all(parts)
    place = F.instr("full", DRIVER)
    key = F.substring(F.col("full"), place + len(DRIVER), F.length("full"))
    rows = rows.where(place > 0).withColumn("key", key)
    in_stream = F.col("key").startswith(STREAMING)
    rest = F.when(in_stream, F.substring(F.col("key"), F.lit(len(STREAMING) + 1), F.length("key"))).otherwise(F.col("key"))
    head, dot = F.substring_index(rest, ".", 1), F.instr(rest, ".")
    tail = F.when(dot > 0, F.substring(rest, dot + 1, F.length(rest)))
    source = (
        F.when(in_stream & tail.isNull(), F.lit("spark.streaming"))
        .when(in_stream, F.concat(F.lit(STREAMING), head))
        .otherwise(head)
    )
    name = F.when(in_stream & tail.isNull(), rest).otherwise(F.coalesce(tail, F.lit("")))
    m = F.col("m")
    number_of = lambda v: F.when(_is_number(v), F.try_variant_get(v, "$", "double"))
    raw = F.try_element_at(m, F.lit("value"))
    flag = F.schema_of_variant(raw) == "BOOLEAN"
    gauge_value = F.when(flag, F.when(F.try_variant_get(raw, "$", "boolean"), 1.0).otherwise(0.0)).otherwise(number_of(raw))
    gauge_text = F.when(raw.isNotNull() & ~F.is_variant_null(raw) & gauge_value.isNull(), F.try_variant_get(raw, "$", "string"))
    units = F.try_element_at(m, F.lit("duration_units"))
    gauge = F.col("kind") == "gauge"
    others = F.map_filter(m, lambda k, v: (k != "count") & _is_number(v))
    return rows.select(
        *keep, "key", source.alias("source"), name.alias("name"), "kind",
        F.when(gauge, gauge_value).otherwise(number_of(F.try_element_at(m, F.lit("count")))).alias("value"),
        F.when(gauge, gauge_text).alias("text"),
        F.when(~gauge, F.transform_values(others, lambda k, v: F.try_variant_get(v, "$", "double"))).alias("fields"),
        F.when(~gauge & (F.schema_of_variant(units) == "STRING"), F.try_variant_get(units, "$", "string")).alias("units"),
    )


def _is_number(v):
    return F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))


# Numbers of a metric that reports read by name.
NAMED_FIELDS = ["m1_rate", "m5_rate", "mean_rate", "mean", "p50", "p95", "max"]


def with_named_fields(metrics):
    return metrics.select(
        "*", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in NAMED_FIELDS]
    )
