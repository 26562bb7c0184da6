"""Column-level building blocks (all JVM expressions)."""
