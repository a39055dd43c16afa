"""Operators over logs, runs and manifests: every one takes and gives DataFrames."""
