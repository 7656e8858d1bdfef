"""Operators over DataFrames: references, aggregates, rules, constraints, list tools, table preparation."""
