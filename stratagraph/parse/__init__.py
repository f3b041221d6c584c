"""Parser backends and the node table that they fill."""
