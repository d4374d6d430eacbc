"""Property-graph analytics as plain DataFrame, SQL and Structured Streaming jobs."""
