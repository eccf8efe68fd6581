"""Composite plans (feature set, fitted detector) and the query registry."""
