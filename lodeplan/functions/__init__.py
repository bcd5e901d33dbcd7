"""Column functions whose semantics Spark's own do not have."""
