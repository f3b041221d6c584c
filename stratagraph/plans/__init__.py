"""Whole plans: the indexing pipeline and the registered queries."""
