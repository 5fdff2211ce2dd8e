"""Continuous alerting."""
