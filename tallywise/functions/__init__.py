"""Column-level building blocks: missing values, predicates, aggregates, checks."""
