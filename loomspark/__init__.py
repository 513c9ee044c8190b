"""Spark jobs for registry, web-page and catalogue data."""
