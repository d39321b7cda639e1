"""Column expressions (JVM side unless the docstring says otherwise)."""
