"""Readers, sinks and the versioned store."""
