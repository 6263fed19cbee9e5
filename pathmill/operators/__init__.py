"""Operators on DataFrames: path joins, filters, aggregation, ordering, set operations, lookups, maintenance, migration."""
