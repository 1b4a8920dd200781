"""Readers and writers for trips and zones."""
