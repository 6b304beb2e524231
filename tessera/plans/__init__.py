"""Metadata queries: predicates, order, pages."""
