"""Column functions and conventions."""
