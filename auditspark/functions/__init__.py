"""Column expressions shared by the operators; everything here stays JVM-side."""
