"""Batch analytics from raw records to verified answers, written as plain Spark jobs."""
