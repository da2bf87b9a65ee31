"""Text classification and triage as Spark DataFrame jobs."""
