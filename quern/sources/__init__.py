"""Reading and keeping tables."""
