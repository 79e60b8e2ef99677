"""Readers, writers and catalog parsers."""
