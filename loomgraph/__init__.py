"""Code-context analytics on Spark: search, graphs, co-change, waves, incremental index."""
