"""Honest-validation jobs for spectral and other wide feature tables, on Spark."""
