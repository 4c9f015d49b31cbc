"""Readers, table adapters, sinks and the feature cache."""
