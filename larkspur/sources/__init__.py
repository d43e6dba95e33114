"""Readers, writers and catalogue views."""
