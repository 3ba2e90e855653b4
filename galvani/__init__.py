"""Spark jobs over graphs held as edge tables: resistance distance and current-flow centrality."""
