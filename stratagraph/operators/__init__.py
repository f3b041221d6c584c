"""DataFrame operators over files, syntax nodes and graph tables."""
