"""Registered queries: test views, wiring and the equivalent SQL."""
