"""Academic-results analytics expressed as Spark DataFrame jobs."""
