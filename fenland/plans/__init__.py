"""Whole jobs: cleaning, warehouse, reports, models."""
