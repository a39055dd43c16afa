"""Log-structured analytics on Spark: versioned key-value logs, runs, manifests and snapshots as DataFrames."""
