"""Event streams: watermarked windows, de-duplication, enrichment, rate limits and mode changes."""
