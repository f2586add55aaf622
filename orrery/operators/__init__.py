"""Operators from DataFrame to DataFrame, each a declarative plan."""
