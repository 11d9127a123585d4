"""Column expressions: attributes, predicates, time, labels."""
