"""Analytics over Spark telemetry tables, written as DataFrame operators."""
