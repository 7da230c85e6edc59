"""Request-evidence analytics expressed as Spark DataFrame jobs."""
