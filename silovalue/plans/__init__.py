"""Fixtures, preparation recipes and the registered queries."""
