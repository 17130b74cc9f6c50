"""Trace-commitment analytics expressed as Spark DataFrame plans."""
