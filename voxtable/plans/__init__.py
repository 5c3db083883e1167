"""Compositions of the operators: the query catalogue and end-to-end plans."""
