"""Scrubline: de-identification, request policy and audit analytics on Spark."""

__version__ = "0.1.0"
