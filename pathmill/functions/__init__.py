"""Column expressions: conditions, aggregates, row hashes and nulls."""
