"""Survival models trained by Spark ML."""
