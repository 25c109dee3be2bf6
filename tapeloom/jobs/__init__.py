"""Registered queries and whole workloads."""
