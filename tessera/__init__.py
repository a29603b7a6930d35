"""Declarative spatio-temporal data integration on Spark."""
