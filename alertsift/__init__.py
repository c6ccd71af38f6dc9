"""Two-stage traffic-alert analytics as plain Spark DataFrame jobs."""
