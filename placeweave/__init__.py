"""Integration of place and facility records as Spark DataFrame jobs."""
