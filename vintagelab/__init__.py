"""Vintage data, releases, leak-free forecasts and their evaluation on Spark."""
