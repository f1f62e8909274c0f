"""Composed jobs, test-table bindings and the query catalog."""
