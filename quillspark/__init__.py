"""Transcript cleaning, text-pair building and interaction-event analytics on Spark."""
