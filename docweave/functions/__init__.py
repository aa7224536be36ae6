"""Column expressions: everything here stays in the JVM and in generated code."""
