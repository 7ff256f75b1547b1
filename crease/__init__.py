"""crease: ball-by-ball match analytics on Spark (ingest, star schema, enrichment, reports)."""

__version__ = "0.1.0"
