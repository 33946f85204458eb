"""Tellurion: geospatial event analytics on Spark, as DataFrame and Column operations."""
