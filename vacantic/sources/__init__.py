"""Readers: landed payloads, seeds, crawl listings and state."""
