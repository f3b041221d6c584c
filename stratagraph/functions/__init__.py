"""Column builders: identity, naming, paths and text rules."""
