"""sources of folioflow."""
