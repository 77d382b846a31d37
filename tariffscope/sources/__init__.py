"""Readers, writers and the demo-table adapter."""
