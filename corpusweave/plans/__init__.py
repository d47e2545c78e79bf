"""The operators aimed at the given tables."""
