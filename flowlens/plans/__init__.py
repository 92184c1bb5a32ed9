"""Composed plans: driver-table bindings, training flows and the query catalog."""
