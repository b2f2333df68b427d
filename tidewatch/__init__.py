"""Flow-table detection and alert analytics as composable Spark DataFrame operators."""
