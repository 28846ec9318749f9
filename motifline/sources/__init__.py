"""Readers of graph and workload text, graphs from tables, result sinks."""
