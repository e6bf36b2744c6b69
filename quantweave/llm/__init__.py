"""Operators for large-scale training-text preparation."""
