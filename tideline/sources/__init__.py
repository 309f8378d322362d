"""Readers, writers and the panels derived from the TPC-H-like tables."""
