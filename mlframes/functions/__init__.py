"""Column expressions: everything here is row-wise and runs inside the JVM."""
