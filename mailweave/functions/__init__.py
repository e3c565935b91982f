"""Scalar functions on columns; all are built-in expressions evaluated inside the JVM."""
