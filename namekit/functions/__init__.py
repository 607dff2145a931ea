"""Column -> Column building blocks (all JVM-side Spark expressions)."""
