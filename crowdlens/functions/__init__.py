"""Column functions. All are plain Column expressions that run inside the JVM."""
