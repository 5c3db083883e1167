"""Readers and writers. Ordered text carries ``idx``, the line's number from 0."""
