"""Column expressions that run inside the JVM, and the few Arrow functions."""
