"""Bodies of Python functions, without Spark."""
