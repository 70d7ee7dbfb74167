"""Batch operators: partitioning, grouping, joins, statistics, balancing."""
