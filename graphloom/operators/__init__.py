"""Operators over DataFrames; every one is a composition of Catalyst plans."""
