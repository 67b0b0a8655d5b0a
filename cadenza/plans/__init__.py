"""Composed plans: the codec end to end, and the registered queries."""
