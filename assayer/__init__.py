"""Judgment data on Spark: records, typed questions, targets, predictions and their metrics."""
