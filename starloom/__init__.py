"""Spark operators for building and checking analytics models."""
