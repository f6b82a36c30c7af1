"""scorebook: game and event analytics as lazy Spark DataFrame jobs."""
