"""Readers of delimited edge lists and community graphs."""
