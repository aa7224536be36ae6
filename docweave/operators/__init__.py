"""Operators on evidence: joins, profiles, sampling, chunking, enrichment, rendering."""
