"""Layered, traceable knowledge tables on Spark."""
