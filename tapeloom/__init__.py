"""Spark jobs for trading-strategy research data."""
