"""Where repositories and documents come from."""
