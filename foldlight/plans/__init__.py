"""Workloads that combine operators."""
