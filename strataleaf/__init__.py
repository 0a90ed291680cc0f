"""Strataleaf: analytics over versioned document knowledge, expressed as Spark plans."""
