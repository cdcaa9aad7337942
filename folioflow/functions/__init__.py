"""functions of folioflow."""
