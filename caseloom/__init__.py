"""Process-event analytics as Spark DataFrame operators."""
