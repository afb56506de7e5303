"""Request-usage analytics for search clusters, expressed as Spark DataFrame jobs."""
