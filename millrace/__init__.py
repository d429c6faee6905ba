"""A Spark engine for star-schema loads with quality gates, workflow event logs, task graphs and streams."""
