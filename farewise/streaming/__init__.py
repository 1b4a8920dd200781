"""Incremental ingestion of newly landed trip files."""
