"""Incident-context analytics on Spark."""
