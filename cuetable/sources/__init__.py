"""Readers and writers for media listings, project documents and caches."""
