"""Scans with closed schemas, nested JSON sources, provenance tables and sinks."""
