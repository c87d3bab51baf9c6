"""Readers and derived rasters."""
