"""Column -> Column functions; none of them is a Python UDF."""
