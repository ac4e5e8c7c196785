"""Engines, the staged pipeline and the registered queries."""
