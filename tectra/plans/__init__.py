"""Registered query plans with their oracles."""
