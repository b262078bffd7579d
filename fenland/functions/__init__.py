"""Column helpers: native Spark expressions only, no Python UDF."""
