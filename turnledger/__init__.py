"""Session-memory analytics expressed as Spark table and stream jobs."""
