"""Quantitative-research data work on Spark."""
