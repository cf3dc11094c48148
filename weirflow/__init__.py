"""Versioned incremental dataflow on Spark."""
