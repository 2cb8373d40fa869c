"""Relational, time-series and streaming queries written for Spark at scale."""
