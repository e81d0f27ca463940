"""Column expressions. Everything here is a built-in Spark expression (JVM side)."""
