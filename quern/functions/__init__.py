"""Column helpers: keys and scalars."""
