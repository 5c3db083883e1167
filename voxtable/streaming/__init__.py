"""The stateless line filters and the incremental clustering, on streams."""
