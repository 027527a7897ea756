"""KPI analytics as Spark DataFrame jobs."""
