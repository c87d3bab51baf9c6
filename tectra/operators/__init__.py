"""Image, edge and line operators."""
