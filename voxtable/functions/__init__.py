"""Column functions: everything here is an expression of Spark's own functions, but for what says otherwise."""
