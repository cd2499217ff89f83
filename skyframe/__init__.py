"""Analytics over flight telemetry and map imagery, on Spark."""
