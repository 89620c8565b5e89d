"""Operators over node and edge DataFrames."""
