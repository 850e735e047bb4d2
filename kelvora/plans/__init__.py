"""Canonical views, the registered queries and their SQL."""
