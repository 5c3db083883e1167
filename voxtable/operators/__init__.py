"""DataFrame operators; each takes DataFrames and returns one, so they chain with ``DataFrame.transform``."""
