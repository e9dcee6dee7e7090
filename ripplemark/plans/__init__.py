"""Ready plans: the graph over the driver's tables, and the query catalogue."""
