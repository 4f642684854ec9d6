"""Scalar functions over columns; plain Spark expressions, unless a name says otherwise."""
