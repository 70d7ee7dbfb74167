"""Structured Streaming forms of the join, its statistics, its sinks and its migration."""
