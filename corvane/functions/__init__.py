"""Column expressions: they stay in the JVM and can be used in any DataFrame."""
