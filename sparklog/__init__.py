"""Security-log analytics as DataFrame transforms for Spark."""
