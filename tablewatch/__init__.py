"""Data-quality and observability jobs for Spark tables and streams."""
