"""Interval, track and review-queue analytics as Spark DataFrame operators."""
