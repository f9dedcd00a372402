"""Spark-first analytics for airborne LiDAR forest inventory."""
