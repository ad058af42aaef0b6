"""Analytics on weak and drifting tables, and on training data, as Spark jobs."""
