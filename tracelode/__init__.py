"""Agent-memory analytics expressed as Spark DataFrame programs."""
