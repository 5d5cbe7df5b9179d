"""Content-addressed cache analytics as Spark DataFrame operators."""
