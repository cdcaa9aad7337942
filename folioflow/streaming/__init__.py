"""streaming of folioflow."""
