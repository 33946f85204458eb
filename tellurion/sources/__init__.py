"""Readers and writers: tiles, catalogues, GeoJSON, time-partitioned stacks."""
