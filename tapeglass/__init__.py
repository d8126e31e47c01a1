"""Event-contract trading analytics expressed as Spark DataFrame jobs."""
