"""Footfall: privacy-first web analytics as Spark DataFrame jobs."""
