"""Evigrain: evidence-grounded document analytics as DataFrame, SQL and Structured Streaming operations."""
