"""Operators on long tables: each takes DataFrames and `keys`, the columns that prefix every grouping."""
