"""Derived graphs, the query registry and its SQL oracles."""
