"""Mail-archive analytics expressed as Spark DataFrame jobs."""
