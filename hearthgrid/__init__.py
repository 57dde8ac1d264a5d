"""Geospatial and energy analytics expressed as Spark DataFrame jobs."""
