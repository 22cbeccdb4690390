"""Procurement analytics on Spark: outcome labels, entity histories, features, models."""
