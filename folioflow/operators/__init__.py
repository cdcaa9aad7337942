"""operators of folioflow."""
