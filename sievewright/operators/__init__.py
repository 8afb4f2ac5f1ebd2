"""Relational operators: distributed ranks, components, selection, retrieval, balancing, nested records."""
