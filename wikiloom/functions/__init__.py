"""Scalar functions as Columns: text, vectors and lexemes. All run inside the JVM."""
