"""Composite queries put together from the operators."""
