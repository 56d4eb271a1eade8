"""Support-ticket and IT-operations analytics as Spark DataFrame operators."""
