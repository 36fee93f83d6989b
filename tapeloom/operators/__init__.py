"""Stages of the market-data pipeline as DataFrame transformations."""
