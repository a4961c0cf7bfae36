"""provlake: evidence and provenance analytics as plain Spark DataFrame operators."""
